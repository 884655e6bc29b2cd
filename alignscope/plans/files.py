"""Queries that write with a sink and read back with a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Experiment
from ..analysis import analyse, build_dataset, unify
from ..functions.codec import decode_labels, encode_labels
from ..model import threshold_rank
from ..operators import geometry, quantiles, report, summaries, tally
from ..shared import sent
from ..sources import model, raw, tables, tensors
from ..streaming.quantiles import SketchStore
from . import fixtures as fx
from .fixtures import put, scratch, sql
from .registry import oracle, query
from .summary import _HIST, T


@query("src_csv", "select n_nationkey, n_name, n_regionkey from nation")
def src_csv(spark, d):
    path = scratch(spark, "nation.csv")
    tables.write_csv(fx.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("snk_csv", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def snk_csv(spark, d):
    path = scratch(spark, "customer.csv")
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]
    tables.write_csv(fx.table(spark, d, "customer").select(*columns), path, small=False)
    return tables.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("src_csv_typed", "select s_suppkey, s_name, abs(s_acctbal) as balance from supplier")
def src_csv_typed(spark, d):
    path = scratch(spark, "supplier.csv")
    tables.write_csv(fx.table(spark, d, "supplier").select("s_suppkey", "s_name", F.abs("s_acctbal").alias("balance")), path)
    return tables.read_csv_typed(spark, path)


@query("src_json", "select r_regionkey, r_name from region")
def src_json(spark, d):
    path = scratch(spark, "region.json")
    fx.table(spark, d, "region").write.json(path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


@query("snk_json", "select count(*) as n, cast(sum(length(props)) as bigint) as chars from events")
def snk_json(spark, d):
    path = scratch(spark, "events.json")
    fx.table(spark, d, "events").select("event_id", "props").write.json(path)
    back = spark.read.schema("event_id long, props string").json(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).cast("long").alias("chars"))


@query("src_info", "select r_name as key, cast(r_regionkey as varchar) as value from region")
def src_info(spark, d):
    path = scratch(spark, "info.txt")
    fx.table(spark, d, "region").select(F.concat_ws(": ", "r_name", "r_regionkey").alias("value")).write.text(path)
    return tables.read_info(spark, path)


@query("snk_mmap", sql("act", "select cast(image as bigint) as image, unit, y, x, value from act"))
def snk_mmap(spark, d):
    """Packed, written as Parquet, read and unpacked: the same rows."""
    path = scratch(spark, "packed")
    tensors.pack(fx.activations(spark, d)).write.parquet(path)
    return tensors.explode_packed(spark.read.parquet(path), "image", "values", fx.UNITS, fx.WIDTH)


@query("snk_mat", sql("act", "select unit, cast(k - 1 as int) as idx, round(grid[22 - k], 6) as value from (select unit, quantile_cont(value, [i / 20.0 for i in range(21)]) as grid from act group by unit), range(1, 22) t(k)"))
def snk_mat(spark, d):
    """The quantile matrix, units by quantiles, stored once, exported as a MATLAB file and read back."""
    import numpy as np

    store = Experiment(spark, scratch(spark, "store"))
    grid = store.stage("conv5", "quantiles", lambda: quantiles.quantile_grid(fx.activations(spark, d), count=21))
    matrix = np.zeros((fx.UNITS, 21))
    for r in grid.collect():  # units by quantiles
        matrix[r["unit"], r["idx"]] = r["value"]
    path = scratch(spark, "quantmat.mat")
    put(spark, path, raw.write_mat({"quantmat": matrix}))

    def read(frames):
        import pandas as pd

        for f in frames:
            for content in f["content"]:
                back = raw.read_mat(content)["quantmat"]
                unit, idx = np.indices(back.shape, dtype=np.int32).reshape(2, -1)
                yield pd.DataFrame({"unit": unit, "idx": idx, "value": back.reshape(-1)})

    return spark.read.format("binaryFile").load(path).mapInPandas(read, "unit int, idx int, value double").withColumn("value", F.round("value", 6))


@query("src_glob_latest", "select * from (values ('iter_20.caffemodel', 'quant-01.mmap')) t(latest, latest_decimal)")
def src_glob_latest(spark, d):
    names = ["iter_3.caffemodel", "iter_20.caffemodel", "iter_9.caffemodel"]
    return spark.createDataFrame([(tensors.latest(names), tensors.latest(["quant-005.mmap", "quant-01.mmap", "quant-0025.mmap"], decimal=True))], "latest string, latest_decimal string")


def _unified(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The nations as a small unified dataset: images are nations, one category of labels and one of files."""
    folder = scratch(spark, "unified")
    n = fx.table(spark, d, "nation")
    base = n.select(F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".jpg")).alias("image"), F.when(F.col("n_nationkey") % 3 == 0, "val").otherwise("train").alias("split"), *[F.lit(100).alias(c) for c in ("ih", "iw", "sh", "sw")], "n_nationkey", "n_regionkey")
    scene = base.select(*tables.INDEX, F.lit("scene").alias("category"), F.lit(0).alias("ord"), (F.col("n_regionkey") + 1).alias("label"), F.lit(None).cast("string").alias("file"))
    object_ = base.where("n_nationkey % 2 = 0").select(*tables.INDEX, F.lit("object").alias("category"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("label"), F.concat(F.lit("n"), F.col("n_nationkey"), F.lit("_object.png")).alias("file"))
    index = scene.unionByName(object_)
    region = fx.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("number"), F.lower("r_name").alias("name"))
    label = region.select("number", "name", F.lit("scene(5)").alias("category"), F.lit(5).cast("long").alias("frequency"), F.lit(5.0).alias("coverage"), F.lit("").alias("syns"))
    category = spark.createDataFrame([("scene", 1, 5, 5, 25), ("object", 6, 6, 1, 13)], "name string, first int, last int, count int, frequency long")
    codes = region.select(F.lit("scene").alias("category"), F.col("number").cast("int").alias("code"), "number", "name", F.lit(5).cast("long").alias("frequency"), F.lit(5.0).alias("coverage"))
    tables.write_unified(index, category, label, codes, folder)
    return folder, index


@query("src_index", "select 'n' || n_nationkey || '.jpg' as image, category, label, file from (select n_nationkey, 'scene' as category, n_regionkey + 1 as label, cast(null as varchar) as file from nation union all select n_nationkey, 'object', null, 'n' || n_nationkey || '_object.png' from nation where n_nationkey % 2 = 0)")
def src_index(spark, d):
    folder, _ = _unified(spark, d)
    return tables.read_unified(spark, folder)["index"].select("image", "category", "label", "file")


@query("snk_index", "select cast(r_regionkey + 1 as int) as code, cast(r_regionkey + 1 as int) as number, lower(r_name) as name, cast(5 as bigint) as frequency, cast(5.0 as double) as coverage from region")
def snk_index(spark, d):
    folder, _ = _unified(spark, d)
    return tables.read_codes(spark, folder, "scene")


@query("snk_label_png", sql("pl", "select cast(image as bigint) as image, y, x, label from pl"))
def snk_label_png(spark, d):
    """Label maps as pictures and back: each image's map is one PNG file in a binary column."""
    cell = F.struct("y", "x", "label")
    maps = fx.pixel_labels(spark, d).groupBy("image").agg(F.collect_list(cell).alias("cells"))

    def write(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            out = []
            for cells in f["cells"]:
                grid = np.zeros((fx.WIDTH, fx.WIDTH), np.int64)
                for c in cells:
                    grid[c["y"], c["x"]] = c["label"]
                out.append(encode_labels(grid))
            yield pd.DataFrame({"image": f["image"], "png": out})

    def read(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for image, png in zip(f["image"], f["png"], strict=True):
                grid = decode_labels(png)
                y, x = np.nonzero(grid)
                yield pd.DataFrame({"image": image, "y": y.astype(np.int32), "x": x.astype(np.int32), "label": grid[y, x].astype(np.int32)})

    return maps.mapInPandas(write, "image long, png binary").mapInPandas(read, "image long, y int, x int, label int")


@query("src_dtd", "select 'p' || p_partkey || '.jpg' as image, cast(label as int) as label from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) join (select w, row_number() over (order by w) as label from (select distinct unnest(string_split(p_name, ' ')) as w from part)) using (w)")
def src_dtd(spark, d):
    """An attribute list made of part names."""
    path = scratch(spark, "labels.txt")
    fx.table(spark, d, "part").select(F.concat_ws(" ", F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".jpg")), "p_name").alias("value")).write.text(path)
    return raw.Textures(path).image_labels(spark).select("image", "label")


@query("src_model", sql("act", "select cast(image as bigint) as image, unit, y, x, round(greatest(2 * value + 0.1, 0), 6) as value from act"))
def src_model(spark, d):
    """A one-layer network over the packed vectors."""

    def load():
        import numpy as np

        return lambda v: np.maximum(2 * v + 0.1, 0)

    rows = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    return model.activations(rows, load, shape=(fx.UNITS, fx.WIDTH, fx.WIDTH)).withColumn("value", F.round("value", 6))


@query("src_mean", sql("act", "select unit as channel, round(avg(value), 6) as mean from act group by unit"))
def src_mean(spark, d):
    return model.channel_means(fx.activations(spark, d).withColumnRenamed("unit", "channel")).withColumn("mean", F.round("mean", 6))


_REPORT = oracle("srt_report").replace("select row_number()", "select unit + 1 as unit, 'u' || unit || '.png' as src, row_number()").replace("as place, unit, label", "as place, label")


@query("snk_html", _REPORT)
def snk_html(spark, d):
    """A report with a picture for every unit, written, and its units read back from the page."""
    rows, path = fx.results(spark, d), scratch(spark, "report.html")
    pictures = rows.select("unit", F.format_string("u%d.png", "unit").alias("src"))
    report.write_lines(report.page("events", summaries.report_order(rows, T), summaries.label_histogram(rows, T), pictures), path)
    part = lambda n: F.regexp_extract("value", r'<li value="(\d+)">unit (\d+): (\S+) \((\S+)\) ([\d.]+)<br><img loading="lazy" src="([^"]+)"></li>', n)
    items = spark.read.text(path).where("value like '<li %'")
    return items.select(part(1).cast("long").alias("place"), part(2).cast("long").alias("unit"), part(3).alias("label"), part(4).alias("category"), part(5).cast("double").alias("score"), part(6).alias("src"))


@query("snk_svg", sql("res", f"select place, label, units, cast(14 * (place - 1) as bigint) as x, round(100.0 * units / max(units) over (), 3) as tall from (select label, units, row_number() over (order by units desc, max_score desc, label) as place from ({_HIST}))"))
def snk_svg(spark, d):
    """The bars of a written histogram, read back."""
    path = scratch(spark, "bars.svg")
    report.write_lines(report.bars_svg(summaries.label_histogram(fx.results(spark, d), T)), path)
    part = lambda n: F.regexp_extract("value", r'<rect x="(\d+)" .* height="([\d.]+)" .*<title>(\S+): (\d+)</title>', n)
    bars = spark.read.text(path).where("value like '<rect %'")
    return bars.select((part(1).cast("long") / 14 + 1).cast("long").alias("place"), part(3).alias("label"), part(4).cast("long").alias("units"), part(1).cast("long").alias("x"), part(2).cast("double").alias("tall"))


@query("src_html", sql("res", "select unit + 1 as unit, label, score from res"))
def src_html(spark, d):
    """Scores read back from the lines of a stored report (the result table is the better source)."""
    path = scratch(spark, "report.txt")
    fx.results(spark, d).select(F.format_string("unit %d: %s (%s) %.9f", F.col("unit") + 1, "label", "category", "score").alias("value")).write.text(path)
    part = lambda n: F.regexp_extract("value", r"unit (\d+): (\S+) \((\S+)\) ([\d.]+)", n)
    return spark.read.text(path).select(part(1).cast("long").alias("unit"), part(2).alias("label"), part(4).cast("double").alias("score"))


@query("snk_readme", "select 'documents' as key, cast(count(*) as varchar) as value from documents union all select 'units', '4' union all select 'largest', cast(max(event_id) as varchar) from events")
def snk_readme(spark, d):
    """Provenance as text, read back as facts."""
    path = scratch(spark, "readme.txt")
    facts = {"documents": fx.table(spark, d, "documents").count(), "units": fx.UNITS, "largest": fx.table(spark, d, "events").agg(F.max("event_id")).first()[0]}
    put(spark, path, report.readme(facts).encode())
    return tables.read_info(spark, path)


@query("snk_syns", "select p_name || ': ' || string_agg(p_brand, '; ' order by p_brand) as value from (select distinct p_name, p_brand from part) group by p_name having count(*) > 1")
def snk_syns(spark, d):
    path = scratch(spark, "syns.txt")
    report.alias_lines(fx.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("label"))).write.text(path)
    return spark.read.text(path)


@query("snk_png_graph", sql("res", "select network, category, cast(round(1000 * good / units) as int) as permille from (select network, category, cast(sum(cast(score >= 0.05 as int)) as bigint) as good from res group by all) join (select network as nw, count(*) as units from res group by all) on network = nw"))
def snk_png_graph(spark, d):
    """A line graph of each network over categories, drawn, and its points read back from the picture."""
    import numpy as np

    from ..functions.codec import decode_png

    rows = summaries.fractions(fx.results(spark, d), T).where(F.col("category").isNotNull()).collect()  # networks by categories
    networks, kinds = (sorted({r[c] for r in rows}) for c in ("network", "category"))
    share = {(r["network"], r["category"]): r["fraction"] for r in rows}
    points = []
    for n in networks:
        picture = decode_png(report.line_graph([[share.get((n, k), 0.0) for k in kinds]], 1000, 40))
        for j, k in enumerate(kinds):
            if (n, k) in share:
                points.append((n, k, int(1000 - np.flatnonzero((picture[:, 40 * j] == report.colour(0)).all(1))[0])))
    return spark.createDataFrame(points, "network long, category string, permille int")


#: The best label of each unit and category, over labels of images and of pixels, at the top tenth of activations.
_ANALYSIS = """, t3 as (select unit, round(quantile_cont(value, 1 - 100 / 999.0), 9) as threshold from act group by unit),
m3 as (select image, act.unit as unit, y, x from act join t3 on act.unit = t3.unit where value > threshold),
r as (select image, unit, -1 as label, count(*) as n from m3 group by all union select distinct image, -1, label, 16 from img where label <> 0 union select image, -1, label, count(*) from pl group by all
      union select m3.image, unit, label, count(*) from m3 join img on m3.image = img.image where label <> 0 group by all union select m3.image, unit, label, count(*) from m3 join pl on m3.image = pl.image and m3.y = pl.y and m3.x = pl.x group by all),
c as (select distinct label, category from img union select distinct label, 'pixel' from pl),
ic as (select distinct image, category from img union select distinct image, 'pixel' from pl),
tr as (select label, category, cast(sum(n) as bigint) as truth from r join c using (label) where unit = -1 group by all),
ac as (select unit, category, cast(sum(n) as bigint) as activation from r join ic using (image) where label = -1 group by all),
it as (select unit, label, cast(sum(n) as bigint) as i from r where unit <> -1 and label <> -1 group by all),
s3 as (select unit, category, label, truth, activation, i as "intersect", round(i / (activation + truth - i + 1e-20), 9) as iou from it join tr using (label) join ac using (unit, category)),
b3 as (select * exclude rn from (select *, row_number() over (partition by unit, category order by iou desc, label) as rn from s3) where rn = 1)
select k.unit as unit, k.category as category, label, truth, activation, "intersect", coalesce(iou, 0) as iou
from (select unit, category from (select distinct unit from r where unit <> -1), (select distinct category from c)) k left join b3 on k.unit = b3.unit and k.category = b3.category"""


@query("pipeline_analysis", sql("act img pl", "").rstrip() + _ANALYSIS)
def pipeline_analysis(spark, d):
    """All stages with a store: quantiles, maxima, tally, result."""
    store = Experiment(spark, scratch(spark, "experiment"))
    images, pixels = fx.image_labels(spark, d), fx.pixel_labels(spark, d)
    categories = images.select("label", "category").distinct().unionByName(pixels.select("label", F.lit("pixel").alias("category")).distinct())
    return analyse(store, "embeddings", fx.activations(spark, d), images, pixels, categories, fx.PIXELS, share=0.1)


@query("pipeline_unify", sql("tok siz", "").rstrip() + """, s as (select 'set' || (image % 5) as dataset, category, label, count(*) as frequency, sum(c / cast(pixels as double)) as coverage
from (select image, category, label, count(*) as c from tok group by all) join siz using (image) group by all)
select row_number() over (order by frequency desc, coverage desc, name) as number, name, frequency, coverage
from (select label as name, cast(sum(frequency) as bigint) as frequency, round(sum(coverage), 6) as coverage from s where label <> '-' group by label having sum(frequency) >= 10 and sum(coverage) >= 0.5)""")
def pipeline_unify(spark, d):
    """Words of documents as labels of five sources, unified by name."""
    words = fx.tokens(spark, d).withColumn("dataset", F.concat(F.lit("set"), F.col("image") % 5))
    names = words.select("dataset", "category", "label").distinct().withColumn("names", F.array("label"))
    return unify(words, words.select("image", "pixels").distinct(), names)["vocabulary"].select("number", "name", "frequency", F.round("coverage", 6).alias("coverage"))


_ZOOM = "(select cast(p as int) as p, cast(round_even(p * 3 / 7.0, 0) as int) as o from range(8) t(p))"


@query("pipeline_dataset", sql("pl img", "").rstrip() + f""", z as (select image, 'p' || label as name, count(*) as n from pl join {_ZOOM} a on y = a.o join {_ZOOM} b on x = b.o group by all),
v as (select name, count(*) as frequency, sum(c) as coverage from (select image, 'p' || label as name, count(*) / 16.0 as c from pl group by all union all select distinct image, 'k' || label, 1.0 from img) group by name having count(*) >= 10 and sum(c) >= 0.5)
select cast(image as varchar) as image, 'pixel' as category, z.name as name, n from z join v on z.name = v.name union all select cast(image as varchar), 'whole', 'k' || label, 1 from img where 'k' || label in (select name from v)""")
def pipeline_dataset(spark, d):
    """Labels of pixels and of whole images made into a unified dataset with pictures of twice the size, and read back."""
    folder = scratch(spark, "dataset")
    source = lambda df, kind, name: df.select("image", F.lit("grid").alias("dataset"), F.lit(kind).alias("category"), F.concat(F.lit(name), "label").alias("label"), *[c for c in ("y", "x") if c in df.columns])
    pixels, whole = source(fx.pixel_labels(spark, d), "pixel", "p"), source(fx.image_labels(spark, d), "whole", "k")
    sizes = fx.image_labels(spark, d).select("image", F.lit(fx.PIXELS).alias("pixels"), F.lit(fx.WIDTH).alias("ih"), F.lit(fx.WIDTH).alias("iw"))
    named = pixels.select("dataset", "category", "label").unionByName(whole.select("dataset", "category", "label")).distinct().withColumn("names", F.array("label", F.concat(F.lit("also "), "label"), F.lit("-")))
    build_dataset(folder, pixels, sizes, named, 8, 8, whole)
    back = tables.read_unified(spark, folder)

    def read(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for file, png in zip(f["file"], f["png"], strict=True):
                number, n = np.unique(decode_labels(png), return_counts=True)
                yield pd.DataFrame({"file": file, "number": number.astype(np.int32), "n": n.astype(np.int64)})

    counts = spark.read.parquet(f"{folder}/pictures.parquet").mapInPandas(read, "file string, number int, n long").where("number > 0")
    index = back["index"].select("image", "category", "label", "file")
    drawn = index.join(counts, "file").select("image", "category", "number", "n")
    listed = index.where("label is not null").select("image", "category", F.col("label").alias("number"), F.lit(1).cast("long").alias("n"))
    return drawn.unionByName(listed).join(sent(back["label"].select("number", "name")), "number").select("image", "category", "name", "n")


@query("streaming_quantiles", "select event_type, round(quantile_cont(value, 1 - 100 / 999.0), 6) as exact, true as close from events group by all")
def streaming_quantiles(spark, d):
    """Exact thresholds, and whether those from merged sketches of micro-batches have the right share of values below them, to a
    thousandth and one value."""
    values = fx.table(spark, d, "events").select("event_type", F.col("value").cast("double").alias("value"))
    source, store = scratch(spark, "stream"), SketchStore(scratch(spark, "sketches"), "event_type", k=4096)
    values.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(values.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store.follow(stream, scratch(spark, "offsets")).awaitTermination()
    rank = threshold_rank(0.1)
    below = F.avg((F.col("value") <= F.col("threshold")).cast("int"))
    met = values.join(sent(store.thresholds(spark, 0.1)), "event_type").groupBy("event_type")
    return met.agg(F.round(F.percentile("value", F.lit(rank)), 6).alias("exact"), (F.abs(below - rank) <= 0.001 + 1 / F.count("value")).alias("close"))


def _axes(weights: str, pixels: int) -> str:
    """DuckDB SQL of upsampled maps: ``weights`` is the weight of cell c at pixel p."""
    return f"w as (select p, c, {weights} as w from (select cast(p as int) as p, cast(c as int) as c from range({pixels}) s(p), range(4) t(c))), up as (select image, unit, a.p as y, b.p as x, sum(value * a.w * b.w) as value from act join w a on act.y = a.c join w b on act.x = b.c group by all)"


def _extremes(up: DataFrame) -> DataFrame:
    return up.groupBy("image", "unit").agg(F.round(F.max("value"), 6).alias("highest"), F.round(F.min("value"), 6).alias("lowest"), F.round(F.avg("value"), 6).alias("average"))


_SAME_EXTREMES = "select cast(image as bigint) as image, unit, round(max(value), 6) as highest, round(min(value), 6) as lowest, round(avg(value), 6) as average from up group by all"
#: The polynomial of degree three through the four cells, which has the ends of the pixels' range as its bounds.
_CUBIC = " * ".join(f"case when c = {j} then 1 else (least(greatest((p - 2) / 4.0, 0.0), 3.0) - {j}) / (c - {j}) end" for j in range(4))


@query("ten_upsample_cubic", sql("act", "").rstrip() + f", {_axes(_CUBIC, 16)} {_SAME_EXTREMES}")
def ten_upsample_cubic(spark, d):
    """Per image and unit the largest, least and mean value of cubic maps."""
    return _extremes(geometry.upsample_cubic(fx.activations(spark, d), 4, 16, 2, 4))


def _gauss(center: int, sigma: float, reach: int, scale: int) -> str:
    total = f"(select sum(exp(-0.5 * (k / {sigma}) ** 2)) from range(-{reach}, {reach + 1}) u(k))"
    return f"case when abs(p - {center} - 4 * c) <= {reach} then {scale} * exp(-0.5 * ((p - {center} - 4 * c) / {sigma}) ** 2) / {total} else 0 end"


@query("ten_upsample_gauss", sql("act", "").rstrip() + f", {_axes(_gauss(2, 2.0, 8, 4), 16)} {_SAME_EXTREMES}")
def ten_upsample_gauss(spark, d):
    """The same of blurred maps: fields of 4 pixels, 4 apart."""
    return _extremes(geometry.upsample_gauss(fx.activations(spark, d), 4, 16, geometry.Field(0, 4, 4)))


@query("ten_mask_blur", sql("act", "").rstrip() + f", {_axes(_gauss(4, 0.8, 3, 1), 20)} select unit, count(*) as n from up where round(value, 9) > (select greatest(max(round(value, 9)), 0) * 0.5 from up) group by unit")
def ten_mask_blur(spark, d):
    """Fields of 8 pixels, 4 apart: masked pixels per unit."""
    masks = geometry.mask_set(fx.activations(spark, d), 4, 20, geometry.Field(0, 8, 4))
    return masks.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("ten_normalize_label", sql("img pl", "select cast(image as bigint) as image, layer, count(*) as pixels from (select img.image as image, 0 as layer from img, range(16) union all select image, 1 from pl) group by all"))
def ten_normalize_label(spark, d):
    """Labels of whole images and of pixels in one shape: layers of pixel rows."""
    whole = fx.image_labels(spark, d).select("image", F.lit(0).alias("layer"), F.explode(F.sequence(F.lit(0), F.lit(fx.PIXELS - 1))).alias("p"))
    return whole.select("image", "layer").unionByName(fx.pixel_labels(spark, d).select("image", F.lit(1).alias("layer"))).groupBy("image", "layer").agg(F.count(F.lit(1)).alias("pixels"))


_GOLDEN = """with grid as (select i // 10 as y, i % 10 as x from range(100) t(i)),
m as (select cast(u as int) as unit, y, x from grid, range(8) t(u) where x * x + y * y <= 4 * u * u),
l as (select cast(k as int) as label, y, x from grid, range(6) t(k) where x > 2 * k),
r as (select unit, -1 as label, count(*) as n from m group by unit union all select -1, label, count(*) from l group by label union all select unit, label, count(*) from m join l using (y, x) group by all),
o as (select *, unit <> -1 and label <> -1 and unit not in (select unit from r where label = -1 and n = 100) and label not in (select label from r where unit = -1 and n = 100) as late from r)
select unit, label, n from (select *, row_number() over (order by late, n desc, unit, label) as rn from o) where rn <= 36"""


@query("golden_tally", _GOLDEN)
def golden_tally(spark, d):
    """Eight discs against six half planes on a 10 x 10 grid, cut to 36 rows."""
    grid = spark.range(100).select((F.col("id") / 10).cast("int").alias("y"), (F.col("id") % 10).cast("int").alias("x"), F.lit(0).cast("long").alias("image"))
    each = lambda n, name: grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    discs = each(8, "unit").where("x * x + y * y <= 4 * unit * unit")
    planes = each(6, "k").where("x > 2 * k").withColumn("label", F.col("k") + 1)
    rows = tally.tally(discs, planes).withColumn("label", F.when(F.col("label") > 0, F.col("label") - 1).otherwise(F.col("label")))
    return tally.truncate(rows, 36, pixels=100, both=True).select("unit", "label", "n")
