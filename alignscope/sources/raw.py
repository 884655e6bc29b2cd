"""Adapters for public labelled sets in their own formats. Formats are read as published; no data come with the library."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import class_of, decode_png, label_of
from ..functions.text import norm_name, scene_number, split_names
from ..shared import numbered, sent
from .base import Source


def number_names(names: DataFrame, column: str) -> DataFrame:
    """Sorted distinct names with numbers from 1."""
    return numbered(names.select(column).distinct(), "label", column).withColumn("label", F.col("label").cast("int"))


class Textures(Source):
    """A describable-textures list: each line has a picture's path and its attributes, separated by white space."""

    name = "textures"

    def __init__(self, annotations: str) -> None:
        self.annotations = annotations

    def _rows(self, spark: SparkSession) -> DataFrame:
        parts = F.split(F.trim("value"), r"\s+")
        return spark.read.text(self.annotations).where("trim(value) <> ''").select(F.get(parts, 0).alias("image"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("textures"))

    def images(self, spark):
        return self._rows(spark).select("image", F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"))

    def names(self, spark):
        found = number_names(self._rows(spark).select(F.explode("textures").alias("texture")), "texture")
        return found.select(F.lit("texture").alias("category"), "label", F.array("texture").alias("names"))

    def image_labels(self, spark):
        rows = self._rows(spark).select("image", F.explode("textures").alias("texture"))
        codes = self.names(spark).select("label", F.get("names", 0).alias("texture"))
        return rows.join(sent(codes), "texture").select("image", F.lit("texture").alias("category"), "label")

    def pixel_labels(self, spark):
        return spark.createDataFrame([], "image string, category string, layer int, y int, x int, label int")


def png_pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, y, x, r, g, b of PNG files, read by Spark and decoded in Arrow batches. Files without a green or blue channel repeat red."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rgb = decode_png(content)
                if rgb.shape[2] < 3:
                    rgb = np.repeat(rgb[:, :, :1], 3, 2)
                h, w, _ = rgb.shape
                y, x = np.divmod(np.arange(h * w), w)
                flat = rgb.reshape(h * w, -1).astype(np.int32)
                yield pd.DataFrame({"path": name, "y": y.astype(np.int32), "x": x.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return files.mapInPandas(run, "path string, y int, x int, r int, g int, b int")


class Surfaces(Source):
    """Photos with materials in the red and objects in the green channel, scenes in a table of photos."""

    name = "surfaces"

    def __init__(self, folder: str, supply: tuple[str, ...] = ("material", "object", "scene")) -> None:
        self.folder, self.supply = folder, supply

    def _photos(self, spark: SparkSession) -> DataFrame:
        return spark.read.csv(f"{self.folder}/photos.csv", header=True).select(F.col("photo_id").cast("string").alias("image"), norm_name(F.coalesce("scene_category_name", F.lit(""))).alias("scene"))

    def images(self, spark):
        return self._photos(spark).select("image", F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"))

    def names(self, spark):
        def read(file: str, name: str, number: str, category: str) -> DataFrame:
            raw = spark.read.csv(f"{self.folder}/{file}", header=True)
            return raw.select(F.lit(category).alias("category"), F.col(number).cast("int").alias("label"), F.transform(split_names(F.col(name), r"\s*/\s*"), norm_name).alias("names"))

        scenes = number_names(self._photos(spark).where("scene <> ''"), "scene").select(F.lit("scene").alias("category"), "label", F.array("scene").alias("names"))
        every = read("label-name-colors.csv", "name_name", "green_color", "object").unionByName(read("label-substance-colors.csv", "substance_name", "red_color", "material")).unionByName(scenes)
        return every.where(F.col("category").isin(*self.supply))

    def image_labels(self, spark):
        codes = self.names(spark).where("category = 'scene'").select("label", F.get("names", 0).alias("scene"))
        named = self._photos(spark).join(sent(codes), "scene")
        return named.select("image", F.lit("scene").alias("category"), scene_number(F.col("scene"), F.col("label")).alias("label"))

    def pixel_labels(self, spark):
        pixels = png_pixels(spark, f"{self.folder}/photos-labels").withColumn("image", F.regexp_extract("path", r"([^/]+)\.png$", 1))
        both = pixels.select("image", "y", "x", F.explode(F.array(F.struct(F.lit("material").alias("category"), F.col("r").alias("label")), F.struct(F.lit("object").alias("category"), F.col("g").alias("label")))).alias("p"))
        return both.select("image", "p.category", F.lit(0).alias("layer"), "y", "x", "p.label").where(F.col("label") != 0).where(F.col("category").isin(*self.supply))


class Scenes(Source):
    """Scene pictures whose ``_seg`` file holds classes in red (in tens) and green, with numbered ``_parts`` files."""

    name = "scenes"

    def __init__(self, folder: str, index: DataFrame) -> None:
        """index: image string, scene string; as read from the set's own index (see ``read_mat``)."""
        self.folder, self.index = folder, index

    def images(self, spark):
        return self.index.select("image", F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"))

    def names(self, spark):
        found = number_names(self.index.where("scene is not null"), "scene")
        return found.select(F.lit("scene").alias("category"), "label", F.array(norm_name(F.col("scene"))).alias("names"))

    def image_labels(self, spark):
        codes = number_names(self.index.where("scene is not null"), "scene")
        return self.index.join(sent(codes), "scene").select("image", F.lit("scene").alias("category"), scene_number(F.col("scene"), F.col("label")).alias("label"))

    def pixel_labels(self, spark):
        pixels = png_pixels(spark, self.folder).where(F.col("path").rlike(r"_(seg|parts_\d+)\.png$"))
        layer = F.coalesce(F.try_element_at(F.split(F.regexp_extract("path", r"_parts_(\d+)\.png$", 1), "x"), F.lit(1)).try_cast("int"), F.lit(0))
        part = F.col("path").rlike(r"_parts_\d+\.png$")
        named = pixels.select(F.concat(F.regexp_extract("path", r"([^/]+?)_(?:seg|parts_\d+)\.png$", 1), F.lit(".jpg")).alias("image"), F.when(part, "part").otherwise("object").alias("category"), layer.alias("layer"), "y", "x", class_of(F.col("r"), F.col("g")).alias("label"))
        return named.where("label <> 0")


def label_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """path, y, x, label of a unified set's own label pictures."""
    return png_pixels(spark, folder).select("path", "y", "x", label_of(F.col("r"), F.col("g")).alias("label"))


_PART_LINE = re.compile(r"pimap\{(\w+)\}\('([\w\s]+)'\)\s*=\s*(\d+)")
_PART_LOOP = re.compile(r"for\s+ii\s*=\s*1:(\d+)")
_PART_NUMBERED = re.compile(r"pimap\{(\w+)\}\(sprintf\('([\w\s]+?)_%d',\s*ii\)\)\s*=\s*(\d+)\s*\+\s*ii")


def read_part_key(text: str) -> dict[int, dict[str, int]]:
    """Class number -> part name -> number, from lines of assignments; loops give numbered parts. Reads one small text."""
    out: dict[int, dict[str, int]] = {}
    upto = 0
    for line in text.splitlines():
        if m := _PART_LOOP.search(line):
            upto = int(m[1])
        elif m := _PART_NUMBERED.search(line):
            own = out.setdefault(int(m[1]), {})
            for i in range(1, upto + 1):
                own[f"{m[2]}_{i}"] = int(m[3]) + i
        elif m := _PART_LINE.search(line):
            out.setdefault(int(m[1]), {})[m[2]] = int(m[3])
    return out


def read_index_names(text: str) -> dict[int, str]:
    """``number: name`` lines."""
    return {int(a): b.strip() for a, b in (line.split(":", 1) for line in text.splitlines() if ":" in line)}


def paint(objects: list[tuple[int, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """Masks painted in order, each over those before it."""
    out = np.zeros(shape, np.int32)
    for label, mask in objects:
        out[mask.astype(bool)] = label
    return out


#: Element types of MATLAB 5 files and the numpy types they hold.
_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}


def read_mat(data: bytes) -> dict[str, object]:
    """The variables of a MATLAB 5 file: numbers, text, cells (object arrays) and structures (lists of dicts)."""
    order = "<" if data[126:128] == b"IM" else ">"

    def element(buf: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack(order + "II", buf[at : at + 8])
        if kind >> 16:  # a small element: both in four bytes
            return kind & 0xFFFF, buf[at + 4 : at + 4 + (kind >> 16)], at + 8
        end = at + 8 + size
        return kind, buf[at + 8 : end], end if kind == 15 else (end + 7) // 8 * 8

    def numbers(kind: int, body: bytes) -> np.ndarray:
        return np.frombuffer(body, order + _MAT[kind])

    def parts(body: bytes) -> list[tuple[int, bytes]]:
        out, at = [], 0
        while at < len(body):
            kind, inner, at = element(body, at)
            out.append((kind, inner))
        return out

    def matrix(body: bytes) -> tuple[str, object]:
        if not body:
            return "", np.zeros((0, 0))
        inner = parts(body)
        flags = int(numbers(*inner[0])[0]) & 0xFF
        shape = tuple(int(n) for n in numbers(*inner[1]))
        name = inner[2][1].decode("latin-1")
        rest = inner[3:]
        if flags == 1:
            cells = np.empty(len(rest), object)
            cells[:] = [matrix(b)[1] for _, b in rest]
            return name, cells.reshape(shape, order="F")
        if flags == 2:
            width = int(numbers(*rest[0])[0])
            raw = rest[1][1]
            fields = [raw[i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(raw), width)]
            values = [matrix(b)[1] for _, b in rest[2:]]
            return name, [dict(zip(fields, values[i : i + len(fields)], strict=True)) for i in range(0, len(values), len(fields))]
        values = numbers(*rest[0])
        if flags == 4:
            return name, "".join(map(chr, values)) if shape and shape[0] <= 1 else ["".join(map(chr, r)) for r in values.reshape(shape, order="F")]
        return name, values.reshape(shape, order="F")

    out: dict[str, object] = {}
    at = 128
    while at + 8 <= len(data):
        kind, body, at = element(data, at)
        if kind == 15:
            inner, inside, _ = element(zlib.decompress(body), 0)
            kind, body = inner, inside
        if kind == 14:
            name, value = matrix(body)
            out[name] = value
    return out


def write_mat(variables: dict[str, object]) -> bytes:
    """A MATLAB 5 file that ``read_mat`` reads: arrays of numbers, text, cells (lists) and structures (lists of dicts)."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(name: str, value: object) -> bytes:
        def whole(flags: int, shape: tuple[int, ...], rest: bytes) -> bytes:
            head = element(6, struct.pack("<II", flags, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode("latin-1"))
            return element(14, head + rest)

        if isinstance(value, str):
            return whole(4, (1, len(value)), element(4, np.array(list(map(ord, value)), "<u2").tobytes()))
        if isinstance(value, list) and value and isinstance(value[0], dict):
            fields = list(value[0])
            names = b"".join(f.encode("latin-1").ljust(32, b"\0") for f in fields)
            return whole(2, (1, len(value)), element(5, struct.pack("<i", 32)) + element(1, names) + b"".join(matrix("", v[f]) for v in value for f in fields))
        if isinstance(value, list):
            return whole(1, (len(value), 1), b"".join(matrix("", v) for v in value))
        numbers = np.atleast_2d(np.asarray(value, "<f8"))
        return whole(6, numbers.shape, element(9, numbers.tobytes(order="F")))

    return b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM" + b"".join(matrix(n, v) for n, v in variables.items())


def scene_index(spark: SparkSession, path: str) -> DataFrame:
    """image, folder, scene from the MATLAB index of annotated scenes: one structure of cells, a cell an image."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                index = read_mat(content)["index"][0]
                yield pd.DataFrame({"image": list(np.ravel(index["filename"])), "folder": list(np.ravel(index["folder"])), "scene": list(np.ravel(index["scene"]))}).map(lambda v: v if isinstance(v, str) else None)

    return files.mapInPandas(run, "image string, folder string, scene string")


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, y, x, r, g, b of pictures in any format that Spark's image source decodes (its bytes come blue first)."""
    files = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, h, w, n, data in batch.itertuples(index=False):
                flat = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int32)
                y, x = np.divmod(np.arange(h * w), w)
                at = (2, 1, 0) if n >= 3 else (0, 0, 0)
                yield pd.DataFrame({"path": name, "y": y.astype(np.int32), "x": x.astype(np.int32), **{c: flat[:, k] for c, k in zip("rgb", at, strict=True)}})

    return files.mapInPandas(run, "path string, y int, x int, r int, g int, b int")


def scene_instances(spark: SparkSession, folder: str) -> DataFrame:
    """path, y, x, label, instance of scene annotations: the blue channel's values, numbered from 1 in each picture."""
    from pyspark.sql import Window

    pixels = png_pixels(spark, folder).where(F.col("path").rlike(r"_seg\.png$") & (F.col("b") > 0))
    number = F.dense_rank().over(Window.partitionBy("path").orderBy("b"))
    return pixels.select("path", "y", "x", class_of(F.col("r"), F.col("g")).alias("label"), number.alias("instance"))


def part_maps(objects: list[dict], key: dict[int, dict[str, int]], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Object and part maps of one picture; objects: class_ind, mask, parts (part_name, mask). Later ones lie on top."""
    index = lambda o: int(np.ravel(o["class_ind"])[0])
    whole = paint([(index(o), o["mask"]) for o in objects], shape)
    inner = [(key.get(index(o), {}).get(str(p["part_name"]), 0), p["mask"]) for o in objects for p in (o["parts"] if isinstance(o["parts"], list) else [])]
    return whole, paint([(n, m) for n, m in inner if n], shape)


class Parts(Source):
    """Pictures whose MATLAB files list objects and their parts, with a text that numbers the parts."""

    name = "parts"

    def __init__(self, folder: str, part_key: dict[int, dict[str, int]], class_names: dict[int, str]) -> None:
        self.folder, self.part_key, self.class_names = folder, part_key, class_names

    def images(self, spark):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(self.folder).select(F.regexp_extract("path", r"([^/]+)\.mat$", 1).alias("image"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"))

    def names(self, spark):
        rows = [("object", k, [n]) for k, n in self.class_names.items()]
        rows += [("part", n, [p]) for parts in self.part_key.values() for p, n in parts.items()]
        return spark.createDataFrame(rows, "category string, label int, names array<string>")

    def image_labels(self, spark):
        return spark.createDataFrame([], "image string, category string, label int")

    def pixel_labels(self, spark):
        key = self.part_key

        def run(batches):
            import pandas as pd

            for batch in batches:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    anno = read_mat(content)["anno"][0]
                    objects = anno["objects"]
                    if not objects:
                        continue
                    for category, grid in zip(("object", "part"), part_maps(objects, key, objects[0]["mask"].shape), strict=True):
                        y, x = np.nonzero(grid)
                        yield pd.DataFrame({"image": path.rsplit("/", 1)[-1][:-4], "category": category, "layer": 0, "y": y.astype(np.int32), "x": x.astype(np.int32), "label": grid[y, x]})

        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(self.folder).select("path", "content")
        return files.mapInPandas(run, "image string, category string, layer int, y int, x int, label int")
