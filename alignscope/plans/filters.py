"""Queries that select and project rows of an index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import scene_number
from ..model import quantile_code, threshold_index
from ..sources.tables import has_all, has_any
from . import fixtures as fx
from .registry import query


def _index(spark, d):
    """Long index: an order is an image, its lines' flags are categories, its suppliers labels."""
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("category"), F.col("l_suppkey").alias("label"))


@query("flt_split", "select page_id from pages where cast('0x' || substr(md5(url), 1, 16) as ubigint) / power(2.0, 64) > 0.7")
def flt_split(spark, d):
    from ..functions.hashing import hashed_unit

    return fx.table(spark, d, "pages").where(hashed_unit(F.col("url")) > 0.7).select("page_id")


@query("flt_range", "select o_orderkey from orders where o_orderkey >= 100 and o_orderkey < 900")
def flt_range(spark, d):
    return fx.table(spark, d, "orders").where("o_orderkey >= 100 and o_orderkey < 900").select("o_orderkey")


@query("flt_any_category", "select distinct l_orderkey as image from lineitem where l_returnflag in ('A', 'R')")
def flt_any_category(spark, d):
    return has_any(_index(spark, d), ["A", "R"])


@query("flt_all_category", "select l_orderkey as image from lineitem where l_returnflag in ('A', 'R') group by l_orderkey having count(distinct l_returnflag) = 2")
def flt_all_category(spark, d):
    return has_all(_index(spark, d), ["A", "R"])


@query("flt_category", "select l_orderkey as image, l_suppkey as label from lineitem where l_returnflag = 'N'")
def flt_category(spark, d):
    return _index(spark, d).where(F.col("category").isin("N")).select("image", "label")


@query("flt_nonzero", "select l_orderkey as image, l_suppkey % 4 as label, count(*) as n from lineitem where l_suppkey % 4 <> 0 group by all")
def flt_nonzero(spark, d):
    return _index(spark, d).select("image", (F.col("label") % 4).alias("label")).where("label <> 0").groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))


@query("flt_supply", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def flt_supply(spark, d):
    return fx.table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt_empty_image", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def flt_empty_image(spark, d):
    return fx.table(spark, d, "customer").join(fx.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("flt_tilde_scene", "select c_custkey, case when starts_with(name, '~') then 0 else c_nationkey end as scene from (select c_custkey, c_nationkey, case when c_custkey % 3 = 0 then '~' else '' end || c_name as name from customer)")
def flt_tilde_scene(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("~")).otherwise(F.lit("")), "c_name")
    return fx.table(spark, d, "customer").select("c_custkey", scene_number(name, F.col("c_nationkey")).alias("scene"))


@query("prj_rg", "select l_orderkey, l_linenumber, cast(l_partkey % 256 + 256 * (l_suppkey % 256) as int) as label, cast((l_partkey % 256) // 10 * 256 + l_suppkey % 256 as int) as class from lineitem")
def prj_rg(spark, d):
    from ..functions.codec import class_of, label_of

    r, g = F.col("l_partkey") % 256, F.col("l_suppkey") % 256
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", label_of(r, g).alias("label"), class_of(r, g).alias("class"))


@query("prj_int_idx", "select share, cast(floor(1000 * share + 0.5) as int) as idx from (values (0.005), (0.01), (0.05)) t(s), (select cast(s as double) as share)")
def prj_int_idx(spark, d):
    return spark.createDataFrame([(s, threshold_index(s)) for s in (0.005, 0.01, 0.05)], "share double, idx int")


@query("prj_qcode", "select * from (values ('005', cast(0.005 as double)), ('010', cast(0.01 as double)), ('050', cast(0.05 as double))) t(code, share)")
def prj_qcode(spark, d):
    from ..model import decode_quantile

    return spark.createDataFrame([(quantile_code(s), decode_quantile(quantile_code(s))) for s in (0.005, 0.01, 0.05)], "code string, share double")


@query("prj_supports_order", "select r_name, r_regionkey from region")
def prj_supports_order(spark, d):
    return fx.table(spark, d, "region").select("r_name", "r_regionkey")


def _cells(spark, d):
    """One value for each place of an order."""
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos")).agg((F.min("l_suppkey") % 3).alias("value"))


@query("win_compact", "select k, pos, value, row_number() over (partition by k order by pos) - 1 as place from (select l_orderkey as k, l_linenumber as pos, min(l_suppkey) % 3 as value from lineitem group by all) where value <> 0", ints="place")
def win_compact(spark, d):
    from ..operators.tally import compact

    return compact(_cells(spark, d), ["k"], "pos")


@query("ten_slideleft", "select k, string_agg(cast(value as varchar), ',' order by pos) as row_values from (select l_orderkey as k, l_linenumber as pos, min(l_suppkey) % 3 as value from lineitem group by all) where value <> 0 group by k")
def ten_slideleft(spark, d):
    """Zeros taken out of a packed row: its other values move to the left."""
    rows = _cells(spark, d).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v"))
    kept = F.filter("v", lambda x: x != 0)
    return rows.where(F.size(kept) > 0).select("k", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("row_values"))


@query("ten_onehot", "select l_orderkey as k, max(cast(l_returnflag = 'A' as int)) as a, max(cast(l_returnflag = 'N' as int)) as n, max(cast(l_returnflag = 'R' as int)) as r from lineitem group by all")
def ten_onehot(spark, d):
    hot = [F.max((F.col("l_returnflag") == f).cast("int")).alias(f.lower()) for f in "ANR"]
    return fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*hot)


@query("codec_instance", "select l_orderkey as k, l_partkey, cast(dense_rank() over (partition by l_orderkey order by l_partkey) as int) as instance from lineitem")
def codec_instance(spark, d):
    return fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_partkey")).alias("instance"))
