"""Queries from activations to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import threshold_rank
from ..operators import quantiles, score, tally
from ..shared import numbered, sent
from ..sources import tensors
from . import fixtures as fx
from .fixtures import sql
from .registry import query

PAIRS = "select cast(image as bigint) as image, cast(unit as int) as unit, cast(label as int) as label, cast(n as bigint) as n"


def _ints(df: DataFrame) -> DataFrame:
    return df.select("image", F.col("unit").cast("int").alias("unit"), F.col("label").cast("int").alias("label"), F.col("n").cast("long").alias("n"))


@query("src_mmap", sql("act", "select cast(image as bigint) as image, unit, y, x, value from act"))
def src_mmap(spark, d):
    """The embeddings as the bytes of a flat tensor, and these unpacked."""
    flat = tensors.pack_flat(fx.table(spark, d, "embeddings"), "vec_id", "embedding")
    return tensors.unpack_flat(flat, (None, fx.UNITS, fx.WIDTH, fx.WIDTH))


@query("agg_quantile_grid", sql("act", "select unit, cast(k - 1 as int) as idx, round(grid[22 - k], 6) as value from (select unit, quantile_cont(value, [i / 20.0 for i in range(21)]) as grid from act group by unit), range(1, 22) t(k)"))
def agg_quantile_grid(spark, d):
    return quantiles.quantile_grid(fx.activations(spark, d), count=21).withColumn("value", F.round("value", 6))


@query("quantile_stream", "select l_returnflag as flag, round(quantile_cont(l_extendedprice, 1 - 5 / 999.0), 4) as threshold from lineitem group by all")
def quantile_stream(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"))
    return quantiles.thresholds(rows, "flag").withColumn("threshold", F.round("threshold", 4))


@query("agg_quantile_sketch", sql("thr", "select unit, round(threshold, 6) as exact, true as close from thr"))
def agg_quantile_sketch(spark, d):
    """Exact thresholds, and whether the sketched ones are within a thousandth of the unit's range."""
    act = fx.activations(spark, d)
    met = quantiles.sketch_thresholds(act).withColumnRenamed("threshold", "sketched").join(quantiles.thresholds(act), "unit").join(quantiles.extremes(act), "unit")
    return met.select("unit", F.round("threshold", 6).alias("exact"), (F.abs(F.col("sketched") - F.col("threshold")) <= 0.001 * (F.col("max_value") - F.col("min_value"))).alias("close"))


@query("agg_minmax", sql("act", "select unit, min(value) as min_value, max(value) as max_value from act group by unit"))
def agg_minmax(spark, d):
    return quantiles.extremes(fx.activations(spark, d))


@query("agg_imgmax", sql("act", "select cast(image as bigint) as image, unit, max(value) as value from act group by all"))
def agg_imgmax(spark, d):
    return quantiles.image_maxima(fx.activations(spark, d))


@query("agg_integrate", sql("act", "select unit, round(sum(value * value), 6) as integral from act group by unit"))
def agg_integrate(spark, d):
    return quantiles.integrate(fx.activations(spark, d), lambda v: v * v).withColumn("integral", F.round("integral", 6))


@query("flt_threshold", sql("m", "select cast(image as bigint) as image, unit, y, x from m"))
def flt_threshold(spark, d):
    return fx.masks(spark, d).select("image", "unit", "y", "x")


@query("jn_threshold", sql("act thr", "select cast(image as bigint) as image, act.unit as unit, count(*) as n_act from act join thr on act.unit = thr.unit where value > threshold group by all"))
def jn_threshold(spark, d):
    return fx.masks(spark, d).groupBy("image", "unit").agg(F.count(F.lit(1)).alias("n_act"))


@query("flt_candidates", sql("act thr", "select image, unit from (select cast(image as bigint) as image, unit, max(value) as v from act group by all) join thr using (unit) where v > threshold"))
def flt_candidates(spark, d):
    act = fx.activations(spark, d)
    return quantiles.candidate_units(quantiles.image_maxima(act), quantiles.thresholds(act))


@query("jn_mask_label", sql("m2 pl", "select cast(m2.image as bigint) as image, m2.unit as unit, label, count(*) as n from m2 join pl on m2.image = pl.image and m2.y = pl.y and m2.x = pl.x group by all"))
def jn_mask_label(spark, d):
    return tally.tally(fx.wide_masks(spark, d), fx.pixel_labels(spark, d)).where("unit <> -1 and label <> -1")


@query("agg_tally", sql("tly", f"{PAIRS} from tly"))
def agg_tally(spark, d):
    return _ints(tally.tally(fx.wide_masks(spark, d), fx.pixel_labels(spark, d)))


@query("jn_mask_scalar", sql("tli", f"{PAIRS} from tli"))
def jn_mask_scalar(spark, d):
    return _ints(tally.tally_image_labels(fx.wide_masks(spark, d), fx.image_labels(spark, d), fx.PIXELS))


@query("jn_scalar_scalar", sql("img", "select a.label as label1, b.label as label2, cast(count(*) * 16 as bigint) as n from img a join img b on a.image = b.image and a.category = b.category group by all"))
def jn_scalar_scalar(spark, d):
    a, b = (fx.image_labels(spark, d).select("image", "category", F.col("label").alias(n)) for n in ("label1", "label2"))
    return a.join(b, ["image", "category"]).groupBy("label1", "label2").agg((F.count(F.lit(1)) * fx.PIXELS).alias("n"))


@query("top_tally", sql("tly", f"{PAIRS} from (select *, row_number() over (partition by image order by case when unit <> -1 and label <> -1 then 1 else 0 end, n desc, unit, label) as rn from tly) where rn <= 8"))
def top_tally(spark, d):
    return _ints(tally.truncate(tally.tally(fx.wide_masks(spark, d), fx.pixel_labels(spark, d)), depth=8))


@query("agg_self_tally", sql("m2", "select cast(a.image as bigint) as image, a.unit as u1, b.unit as u2, count(*) as n from m2 a join m2 b on a.image = b.image and a.y = b.y and a.x = b.x and a.unit <= b.unit group by all"))
def agg_self_tally(spark, d):
    return tally.self_tally(fx.wide_masks(spark, d))


@query("jn_self", "select a.s as u1, b.s as u2, count(*) as n from (select distinct l_orderkey as k, l_suppkey % 8 as s from lineitem) a join (select distinct l_orderkey as k, l_suppkey % 8 as s from lineitem) b on a.k = b.k and a.s <= b.s group by all")
def jn_self(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_suppkey") % 8).alias("unit"), F.lit(0).alias("y"), F.lit(0).alias("x")).distinct()
    return tally.self_tally(rows).groupBy("u1", "u2").agg(F.sum("n").alias("n"))


@query("tally_large", "select unit, label, count(*) as n from (select distinct l_orderkey as k, l_linenumber as y, cast(l_suppkey % 8 as int) as unit from lineitem) a join (select l_orderkey as k, l_linenumber as y, cast(l_partkey % 16 as int) as label from lineitem) b on a.k = b.k and a.y = b.y group by all")
def tally_large(spark, d):
    """Lines of an order are pixels with units and a bag of labels: tallied by order, then summed."""
    rows = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("y"), F.lit(0).alias("x"), (F.col("l_suppkey") % 8).cast("int").alias("unit"), (F.col("l_partkey") % 16 + 1).cast("int").alias("label"))
    rows = tally.tally(rows.select("image", "y", "x", "unit").distinct(), rows.select("image", "y", "x", "label")).where("unit <> -1 and label <> -1")
    return rows.groupBy("unit", (F.col("label") - 1).alias("label")).agg(F.sum("n").alias("n"))


@query("agg_reduce", "select l_returnflag as key, round(sum(l_quantity), 4) as total, min(l_quantity) as low, max(l_quantity) as high from lineitem group by all")
def agg_reduce(spark, d):
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key")).agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("agg_merge", sql("m2 pl", "select unit, label, cast(sum(n) as bigint) as n from (select image, m2.unit as unit, label, count(*) as n from m2 join pl using (image, y, x) group by all) group by all"))
def agg_merge(spark, d):
    """Partial histograms of images merged over all of them."""
    rows = tally.tally(fx.wide_masks(spark, d), fx.pixel_labels(spark, d)).where("unit <> -1 and label <> -1")
    return rows.groupBy("unit", "label").agg(F.sum("n").alias("n"))


def _image_tally(spark, d):
    return tally.tally_image_labels(fx.wide_masks(spark, d), fx.image_labels(spark, d), fx.PIXELS)


@query("agg_summary", sql("tli", "select kind, id1, id2, n from (select 'activation' as kind, unit as id1, -1 as id2, cast(sum(n) as bigint) as n from tli where label = -1 group by all union all select 'truth', -1, label, cast(sum(n) as bigint) from tli where unit = -1 group by all union all select 'intersect', unit, label, cast(sum(n) as bigint) from tli where unit <> -1 and label <> -1 group by all)"))
def agg_summary(spark, d):
    units, labels, pairs = score.summarise(_image_tally(spark, d))
    none = F.lit(-1)
    shape = lambda df, kind, a, b, n: df.select(F.lit(kind).alias("kind"), a.cast("int").alias("id1"), b.cast("int").alias("id2"), F.col(n).alias("n"))
    return shape(units, "activation", F.col("unit"), none, "activation").unionByName(shape(labels, "truth", none, F.col("label"), "truth")).unionByName(shape(pairs, "intersect", F.col("unit"), F.col("label"), "intersect"))


@query("agg_act_in_category", sql("a", "select unit, category, activation from a"))
def agg_act_in_category(spark, d):
    return score.activation_in(_image_tally(spark, d), fx.image_labels(spark, d), "category")


@query("jn_category_semi", sql("m2 img", "select unit, count(*) as n from m2 where image in (select image from img where category = 'c1') group by unit"))
def jn_category_semi(spark, d):
    return fx.wide_masks(spark, d).join(fx.image_labels(spark, d).where("category = 'c1'"), "image", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@query("agg_act_in_label", sql("tli img", "select tli.unit as unit, k.label as label, cast(sum(n) as bigint) as activation from tli join (select distinct image, label from img) k using (image) where tli.label = -1 group by all"))
def agg_act_in_label(spark, d):
    return score.activation_in(_image_tally(spark, d), fx.image_labels(spark, d), "label")


@query("jn_label_semi", sql("m2 img", "select unit, count(*) as n from m2 where image in (select image from img where label = 1) group by unit"))
def jn_label_semi(spark, d):
    return fx.wide_masks(spark, d).join(fx.image_labels(spark, d).where("label = 1"), "image", "left_semi").groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def scored(spark, d):
    """The tally is summed once per role; its masks are the expensive part and are shared by all three."""
    rows = _image_tally(spark, d)
    images = fx.image_labels(spark, d)
    _, truth, pairs = score.summarise(rows)
    labels = truth.join(images.select("label", "category").distinct(), "label")
    return score.score(pairs, score.activation_in(rows, images, "category"), labels).select("unit", "category", "label", "truth", "activation", "intersect", "iou")


@query("agg_iou", sql("sc", "select unit, category, label, truth, activation, \"intersect\", iou from sc"))
def agg_iou(spark, d):
    return scored(spark, d)


@query("agg_best_label", sql("bl act", "select k.unit as unit, k.category as category, label, truth, activation, \"intersect\", coalesce(iou, 0) as iou from (select unit, category from (select distinct unit from act), (select unnest(['c0', 'c1', 'c2']) as category)) k left join bl on k.unit = bl.unit and k.category = bl.category"))
def agg_best_label(spark, d):
    """With a category that no image has: its label is null and its score 0."""
    best = score.best_label(scored(spark, d)).drop("rn")
    return score.every_category(best, fx.activations(spark, d), ["c0", "c1", "c2"]).select("unit", "category", "label", "truth", "activation", "intersect", "iou")


@query("agg_best_category", sql("bl", "select unit, category, label, iou from (select *, row_number() over (partition by unit order by iou desc, category desc) as rn from bl) where rn = 1"))
def agg_best_category(spark, d):
    return score.best_category(score.best_label(scored(spark, d))).select("unit", "category", "label", "iou")


@query("core_best_label", sql("m img", "select u + 1 as unit, label, truth, act, intersect_ as \"intersect\", round(intersect_ / (act + truth - intersect_ + 1e-20), 9) as iou from (select *, row_number() over (partition by u order by round(intersect_ / (act + truth - intersect_ + 1e-20), 9) desc, label) as rn from (select m.unit as u, label, count(*) as intersect_ from m join img on m.image = img.image group by all) join (select unit as u, count(*) as act from m group by all) using (u) join (select label, count(*) * 16 as truth from img group by all) using (label)) where rn = 1"))
def core_best_label(spark, d):
    """Best label of each unit, with thresholds at the top half percent and labels of whole images."""
    counts = fx.masks(spark, d).groupBy("image", "unit").agg(F.count(F.lit(1)).alias("n"))
    labels = fx.image_labels(spark, d).select("image", "label")
    act = counts.groupBy("unit").agg(F.sum("n").alias("act"))
    truth = labels.groupBy("label").agg((F.count(F.lit(1)) * fx.PIXELS).alias("truth"))
    pairs = counts.join(labels, "image").groupBy("unit", "label").agg(F.sum("n").alias("intersect"))
    met = pairs.join(sent(act), "unit").join(truth, "label")
    met = met.withColumn("iou", F.round(score.iou(F.col("intersect"), F.col("act"), F.col("truth")), 9))
    return score.first_in(met, ["unit"], F.desc("iou"), F.col("label")).select((F.col("unit") + 1).alias("unit"), "label", "truth", "act", "intersect", "iou")


_WIDE = ", ".join(f"max(case when category = '{c}' then \"{f}\" end) as {c}_{f}" for c in ("c0", "c1") for f in ("label", "truth", "activation", "intersect", "iou"))


@query("agg_pivot", sql("bl", f"select unit, {_WIDE} from bl group by unit"))
def agg_pivot(spark, d):
    return score.wide(score.best_label(scored(spark, d)), ["c0", "c1"])


@query("srt_units", sql("bl", "select unit, iou, row_number() over (order by iou desc, unit) as place from (select unit, max(iou) as iou from bl group by unit)"))
def srt_units(spark, d):
    return numbered(score.best_category(score.best_label(scored(spark, d))).select("unit", "iou"), "place", F.desc("iou"), "unit")


@query("top_images_max", sql("act", "select unit, image, value, rank from (select *, row_number() over (partition by unit order by value desc, image) as rank from (select unit, cast(image as bigint) as image, max(value) as value from act group by all)) where rank <= 10"), ints="rank")
def top_images_max(spark, d):
    return score.top_per(quantiles.image_maxima(fx.activations(spark, d)), "unit", "value", "image", 10)


@query("top_images_act", sql("m2", "select unit, image, n, rank from (select *, row_number() over (partition by unit order by n desc, image) as rank from (select unit, cast(image as bigint) as image, count(*) as n from m2 group by all)) where rank <= 10"), ints="rank")
def top_images_act(spark, d):
    return score.top_per(fx.wide_masks(spark, d).groupBy("unit", "image").agg(F.count(F.lit(1)).alias("n")), "unit", "n", "image", 10)


@query("duplicate_rule", sql("tli tly", f"{PAIRS} from (select *, row_number() over (partition by image, unit, label order by rk desc) as rn from (select *, 0 as rk from tli union all select *, 1 from tly)) where rn = 1"))
def duplicate_rule(spark, d):
    whole = _image_tally(spark, d).withColumn("source_rank", F.lit(0))
    pixel = tally.tally(fx.wide_masks(spark, d), fx.pixel_labels(spark, d)).withColumn("source_rank", F.lit(1))
    return _ints(tally.pixel_row_wins(whole.unionByName(pixel)))


@query("set_concat_tally", sql("tli tly", "select part, count(*) as n_rows, cast(sum(n) as bigint) as n from (select 'image' as part, n from tli union all select 'pixel', n from tly) group by part"))
def set_concat_tally(spark, d):
    whole, pixel = _image_tally(spark, d), tally.tally(fx.wide_masks(spark, d), fx.pixel_labels(spark, d))
    both = whole.withColumn("part", F.lit("image")).unionByName(pixel.withColumn("part", F.lit("pixel")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n"))


@query("ten_maskset_labels", sql("m2", "select cast(image as bigint) as image, unit as label, n, n = 16 as is_whole from (select image, unit, count(*) as n from m2 group by all)"))
def ten_maskset_labels(spark, d):
    """A mask set as labels; a mask of all pixels is a label of the whole image."""
    n = fx.wide_masks(spark, d).groupBy("image", "unit").agg(F.count(F.lit(1)).alias("n"))
    return n.select("image", F.col("unit").alias("label"), "n", (F.col("n") == fx.PIXELS).alias("is_whole"))


@query("jn_instance_paint", sql("m2", "select cast(image as bigint) as image, y, x, max(unit) as label from m2 group by all"))
def jn_instance_paint(spark, d):
    """Masks painted one over the other in the order of their units: the last one shows."""
    return fx.wide_masks(spark, d).groupBy("image", "y", "x").agg(F.max_by("unit", "unit").alias("label"))


assert abs(threshold_rank() - (1 - 5 / 999)) < 1e-12
