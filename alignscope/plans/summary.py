"""Queries that summarise results and compare networks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import score, summaries
from ..shared import numbered, sent
from . import fixtures as fx
from .fixtures import sql
from .registry import query

T = 0.05
_MODE = "select label, category from (select label, category, row_number() over (partition by label order by count(*) desc, min(unit)) as rn from res where score >= 0.05 group by label, category) where rn = 1"
_HIST = f"select h.label as label, units, max_score, category from (select label, count(*) as units, max(score) as max_score from res where score >= 0.05 group by label) h join ({_MODE}) m on h.label = m.label"


@query("agg_mode", sql("res", _MODE))
def agg_mode(spark, d):
    return summaries.mode(fx.results(spark, d).where(F.col("score") >= T), "label", "category", "unit")


@query("agg_label_histogram", sql("res", _HIST))
def agg_label_histogram(spark, d):
    return summaries.label_histogram(fx.results(spark, d), T)


@query("jn_bargraph_cat", sql("res", f"select unit, res.label as label, h.category as label_category, units from res join ({_HIST}) h on res.label = h.label where score >= 0.05"))
def jn_bargraph_cat(spark, d):
    rows = fx.results(spark, d).where(F.col("score") >= T).select("unit", "label")
    return rows.join(sent(summaries.label_histogram(fx.results(spark, d), T).select("label", F.col("category").alias("label_category"), "units")), "label")


@query("srt_labels", sql("res", "select label, n, max_score, row_number() over (order by n desc, max_score desc, label) as place from (select label, count(*) as n, max(score) as max_score from res where score >= 0.05 group by label)"))
def srt_labels(spark, d):
    h = fx.results(spark, d).where(F.col("score") >= T).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))
    return numbered(h, "place", F.desc("n"), F.desc("max_score"), "label")


@query("agg_fraction", sql("res", "select network, category, good, round(good / units, 9) as fraction from (select network, category, cast(sum(cast(score >= 0.05 as int)) as bigint) as good from res group by grouping sets ((network, category), (network))) join (select network as nw, count(*) as units from res group by all) on network = nw"))
def agg_fraction(spark, d):
    return summaries.fractions(fx.results(spark, d), T)


@query("agg_detectors", sql("res", "select network, category, count(*) as detectors, count(distinct label) as unique_detectors from res where score > 0.05 group by grouping sets ((network, category), (network))"))
def agg_detectors(spark, d):
    return summaries.detectors(fx.results(spark, d), T)


@query("agg_histc", sql("res", "select network, label, count(*) as n, row_number() over (partition by network order by count(*) desc, label) as place from res where score > 0.05 group by network, label"), ints="place")
def agg_histc(spark, d):
    n = fx.results(spark, d).where(F.col("score") > T).groupBy("network", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("network").orderBy(F.desc("n"), "label")))


@query("agg_net_order", sql("res", "select network, total, row_number() over (order by total desc, network) as place from (select network, cast(sum(u) as bigint) as total from (select network, category, count(distinct label) as u from res where score > 0.05 group by all) group by network)"))
def agg_net_order(spark, d):
    unique = summaries.detectors(fx.results(spark, d), T).where(F.col("category").isNotNull())
    total = unique.groupBy("network").agg(F.sum("unique_detectors").alias("total"))
    return numbered(total, "place", F.desc("total"), "network")


@query("agg_distinct", sql("res", "select category, count(distinct label) as n_labels from res where score >= 0.05 group by category"))
def agg_distinct(spark, d):
    return fx.results(spark, d).where(F.col("score") >= T).groupBy("category").agg(F.countDistinct("label").alias("n_labels"))


@query("flt_score", sql("res", "select unit, label, score from res where score >= 0.05"))
def flt_score(spark, d):
    return fx.results(spark, d).where(F.col("score") >= T).select("unit", "label", "score")


@query("flt_score_strict", sql("res", "select unit, label, score from res where score > 0.05"))
def flt_score_strict(spark, d):
    return fx.results(spark, d).where(F.col("score") > T).select("unit", "label", "score")


@query("srt_report", sql("res", f"""select row_number() over (order by cast(score < 0.05 as int), case when score >= 0.05 then -cu end nulls first, case when score >= 0.05 then lc end nulls first, case when score >= 0.05 then -units end nulls first, case when score >= 0.05 then -max_score end nulls first, case when score >= 0.05 then label end nulls first, -score, unit) as place, unit, label, category, score
from (select res.*, h.category as lc, h.units as units, h.max_score as max_score, cu from res left join ({_HIST}) h on res.label = h.label left join (select category as k, count(*) as cu from res where score >= 0.05 group by category) c on h.category = c.k)"""))
def srt_report(spark, d):
    return summaries.report_order(fx.results(spark, d), T)


@query("win_score_order", sql("res", "select network, unit, rank() over (partition by network order by score desc) as place from res"), ints="place")
def win_score_order(spark, d):
    return fx.results(spark, d).select("network", "unit", F.rank().over(Window.partitionBy("network").orderBy(F.desc("score"))).alias("place"))


@query("agg_primary_category", "select user_id as label, category from (select *, row_number() over (partition by user_id order by coverage desc, category desc) as rn from (select user_id, event_type as category, round(sum(value), 6) as coverage from events group by all)) where rn = 1")
def agg_primary_category(spark, d):
    c = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("label"), F.col("event_type").alias("category")).agg(F.round(F.sum("value"), 6).alias("coverage"))
    return score.primary_category(c.withColumn("cat_idx", F.col("category")))


@query("src_matlab_csv", sql("res", "select network, unit, label, score from res where category = 'click'"))
def src_matlab_csv(spark, d):
    """The label and score columns of one category of stored results."""
    return fx.results(spark, d).where("category = 'click'").select("network", "unit", "label", "score")


@query("top_loadings", sql("act", "select unit, image, value, rank from (select unit, cast(image as bigint) as image, value, row_number() over (partition by unit order by abs(value) desc, image, y, x) as rank from act) where rank <= 5"), ints="rank")
def top_loadings(spark, d):
    order = Window.partitionBy("unit").orderBy(F.desc(F.abs("value")), "image", "y", "x")
    return fx.activations(spark, d).withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("unit", "image", "value", "rank")
