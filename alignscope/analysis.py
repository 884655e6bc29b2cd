"""The whole analysis of one bank of units, stage by stage, and the unification of labelled sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import Experiment
from .functions.codec import encode_labels
from .functions.hashing import hashed_unit
from .model import MARGINAL, TALLY_DEPTH, TOP_SHARE, quantile_code
from .operators import labels as lb
from .operators import quantiles, report, score, tally
from .shared import cut, sent
from .sources import tables

STAGES = ("quantiles", "imgmax", "tally", "result")


def analyse(
    store: Experiment,
    blob: str,
    activations: DataFrame,
    image_labels: DataFrame,
    pixel_labels: DataFrame,
    categories: DataFrame,
    pixels: int,
    share: float = TOP_SHARE,
    depth: int | None = TALLY_DEPTH,
    force: bool = False,
    end_after: str | None = None,
    exact_upto: int = quantiles.EXACT_UPTO,
) -> DataFrame:
    """unit, category, label, truth, activation, intersect, iou: the best label of each unit and category.

    ``activations`` are on the labels' grid. ``categories``: label, category. Each stage is stored and taken from the
    store when it is there. A stage named by ``end_after`` is the last one. With more than ``exact_upto`` values a unit,
    thresholds are sketched.
    """
    limits = store.stage(blob, "quantiles-" + quantile_code(share), lambda: quantiles.bounded_thresholds(activations, share=share, exact_upto=exact_upto), force)
    if end_after == "quantiles":
        return limits
    maxima = store.stage(blob, "imgmax", lambda: quantiles.image_maxima(activations), force)
    if end_after == "imgmax":
        return maxima

    def tallied() -> DataFrame:
        some = activations.join(quantiles.candidate_units(maxima, limits), ["image", "unit"], "left_semi")
        masks = quantiles.masks(some, limits)
        whole = tally.tally_image_labels(masks, image_labels, pixels).withColumn("source_rank", F.lit(0))
        rows = tally.pixel_row_wins(whole.unionByName(tally.tally(masks, pixel_labels).withColumn("source_rank", F.lit(1))))
        return tally.truncate(rows, depth, pixels) if depth else rows

    rows = store.stage(blob, "tally-" + quantile_code(share), tallied, force)
    if end_after == "tally":
        return rows

    def result() -> DataFrame:
        both = image_labels.select("image", "label").unionByName(pixel_labels.select("image", "label")).distinct()
        _, truth, pairs = score.summarise(rows)
        few = sent(categories)
        named = truth.join(few, "label")
        images = both.join(few, "label").select("image", "category")
        best = score.best_label(score.score(pairs, score.activation_in(rows, images, "category"), named)).drop("rn")
        kinds = sorted(r["category"] for r in categories.select("category").distinct().collect())  # a handful
        return score.every_category(best, rows.where(f"unit <> {MARGINAL}"), kinds)

    return store.stage(blob, "result", result, force)


def unify(pixels: DataFrame, sizes: DataFrame, names: DataFrame, min_frequency: int = 10, min_coverage: float = 0.5, images: DataFrame | None = None) -> dict[str, DataFrame]:
    """Labels of several sources as one vocabulary.

    pixels: image, dataset, category, label (and pixels, see ``label_statistics``); sizes: image, pixels; images: the same
    as pixels for labels of whole images; names: dataset, category, label, names array<string>, of which empty ones and
    "-" name nothing. A null dataset or category is one like any other.
    Returns statistics per source label, the numbered vocabulary (with its frequency in each category, as text, and the
    other names of its labels), the mapping of source labels to numbers, the dense codes of each category, and the images
    with a reproducible split.
    """
    stats = cut(lb.label_statistics(pixels, sizes, images))  # read several times below; pixels are counted once
    names = names.withColumn("names", F.filter("names", lambda n: ~n.isin("", "-")))
    parts = ["dataset", "category", "label"]
    key = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in parts])
    given = names.select("names", *[F.col(c).alias(f"given_{c}") for c in parts])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"given_{c}")) for c in parts])
    known = cut(stats.join(given, same).select(key.alias("key"), "names", "frequency", "coverage"))
    named = cut(stats.withColumn("key", key).join(lb.called_names(known), "key"))
    total = named.groupBy("name").agg(F.sum("frequency").alias("frequency"), F.sum("coverage").alias("coverage"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("rank"), "category"))), lambda c: F.format_string("%s(%d)", F.coalesce(c["category"], F.lit("-")), -c["rank"]))
    kinds = named.groupBy("name", "category").agg(F.sum("frequency").alias("frequency")).groupBy("name").agg(F.array_join(shown, ";").alias("category"))
    meant = known.select("key", F.explode("names").alias("other")).join(named.select("key", "name"), "key").where("other <> name")
    syns = meant.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("other")), ";").alias("syns"))
    kept = lb.frequent(total, min_frequency, min_coverage).join(kinds, "name").join(syns, "name", "left").withColumn("syns", F.coalesce("syns", F.lit("")))
    vocabulary = lb.number_labels(kept, "name")
    mapping = lb.remap(named.select("dataset", "category", "label", "name"), vocabulary.select("name", "number"), ["name"])
    per = named.groupBy("category", "name").agg(F.sum("frequency").alias("frequency"), F.sum("coverage").alias("coverage")).join(sent(vocabulary.select("name", "number")), "name")
    splits = sizes.select("image", lb.split_of(hashed_unit(F.col("image").cast("string")), [("train", 0.7), ("val", 0.3)]).alias("split"))
    return {"statistics": stats, "vocabulary": vocabulary, "mapping": mapping, "codes": lb.dense_codes(per, "name"), "images": splits}


def build_dataset(folder: str, pixels: DataFrame, sizes: DataFrame, names: DataFrame, height: int, width: int, images: DataFrame | None = None, min_frequency: int = 10, min_coverage: float = 0.5) -> None:
    """A unified dataset folder of several sources, as ``sources.tables.read_unified`` reads it.

    As in ``unify``, with y and x in pixels, and ih and iw (a picture's height and width) in sizes. Each image and category
    with labelled pixels becomes a label picture of the given height and width, scaled without mixing labels; pictures
    stand in ``pictures.parquet`` (file, png), so any store will do. Labels of whole images stand in the index, the most
    frequent one first. A picture is one row while it is scaled.
    """
    spark = pixels.sparkSession
    made = unify(pixels, sizes, names, min_frequency, min_coverage, images)
    numbers = cut(made["mapping"].where("number > 0").select("dataset", "category", "label", "number"))
    vocabulary = cut(made["vocabulary"])
    key = ["dataset", "category", "label"]
    cells = pixels.join(sent(numbers), key).groupBy("image", "category").agg(F.collect_list(F.struct("y", "x", "number")).alias("cells"))
    base = made["images"].join(sizes.select("image", "ih", "iw").distinct(), "image").withColumns({"sh": F.lit(height), "sw": F.lit(width)})

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pngs = []
            for cs, h, w in zip(f["cells"], f["ih"], f["iw"], strict=True):
                grid = np.zeros((h, w), np.int64)
                for c in cs:
                    grid[c["y"], c["x"]] = c["number"]
                places = (np.rint(np.arange(n) * (old - 1) / max(n - 1, 1)).astype(int) for n, old in ((height, h), (width, w)))
                pngs.append(encode_labels(grid[np.ix_(*places)]))
            yield pd.DataFrame({"file": f["image"].astype(str) + "_" + f["category"] + ".png", "png": pngs})

    cells.join(base, "image").select("image", "category", "cells", "ih", "iw").mapInPandas(draw, "file string, png binary").write.parquet(f"{folder}/pictures.parquet")
    painted = cells.select("image", "category").withColumns({"ord": F.lit(0), "label": F.lit(None).cast("int"), "file": F.concat_ws("", F.col("image").cast("string"), F.lit("_"), "category", F.lit(".png"))})
    if images is not None:
        own = images.join(sent(numbers), key).select("image", "category", "number").distinct().join(sent(vocabulary.select("number", "frequency")), "number")
        order = Window.partitionBy("image", "category").orderBy(F.desc("frequency"), "number")
        whole = own.withColumn("ord", F.row_number().over(order)).select("image", "category", "ord", F.col("number").cast("int").alias("label"), F.lit(None).cast("string").alias("file"))
        painted = painted.unionByName(whole)
    index = painted.join(base, "image").select(F.col("image").cast("string").alias("image"), "split", "ih", "iw", "sh", "sw", "category", "ord", "label", "file")
    codes = cut(made["codes"])
    kinds = lb.category_statistics(codes).select(F.col("category").alias("name"), F.col("first_number").cast("int").alias("first"), F.col("last_number").cast("int").alias("last"), F.col("n_labels").cast("int").alias("count"), "frequency")
    tables.write_unified(index, kinds, vocabulary.select("number", "name", "category", "frequency", "coverage", "syns"), codes.select("category", "code", "number", "name", "frequency", "coverage"), folder)
    facts = {"labels": vocabulary.count(), "images": base.count(), "pictures": f"{height} x {width}", "least frequency": min_frequency, "least coverage": min_coverage}
    spark.createDataFrame([(report.readme(facts),)], "value string").write.text(f"{folder}/README.txt")
