"""Queries on label vocabularies: statistics, numbering, names, mappings and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed_unit
from ..operators import labels
from ..shared import numbered, sent
from ..sources.base import union
from . import fixtures as fx
from .fixtures import sql
from .registry import query


def stats(spark, d):
    return labels.label_statistics(fx.tokens(spark, d))


def vocabulary(spark, d):
    """Labels of all datasets together, with the usual least frequency and coverage."""
    total = stats(spark, d).groupBy("category", "label").agg(F.sum("frequency").alias("frequency"), F.round(F.sum("coverage"), 6).alias("coverage"))
    return labels.frequent(total, 10, 0.5)


@query("agg_label_stats", sql("st", "select dataset, category, label, frequency, round(coverage, 6) as coverage from st"))
def agg_label_stats(spark, d):
    return stats(spark, d).withColumn("coverage", F.round("coverage", 6))


@query("flt_min_freq_cov", sql("voc", "select category, label, frequency, coverage from voc"))
def flt_min_freq_cov(spark, d):
    return vocabulary(spark, d)


@query("win_label_number", sql("voc", "select label, category, row_number() over (order by frequency desc, coverage desc, label, category) as number from voc"))
def win_label_number(spark, d):
    v = vocabulary(spark, d).withColumn("key", F.struct("label", "category"))
    return labels.number_labels(v, "key").select("label", "category", "number")


@query("win_dense_code", sql("voc", "select label, category, row_number() over (partition by category order by frequency desc, coverage desc, label) as code from voc"), ints="code")
def win_dense_code(spark, d):
    return labels.dense_codes(vocabulary(spark, d)).select("label", "category", "code")


@query("agg_category_stats", "select r_name as category, min(n_nationkey) as first_number, max(n_nationkey) as last_number, count(*) as n_labels, cast(sum(c) as bigint) as frequency from nation join region on n_regionkey = r_regionkey join (select c_nationkey, count(*) as c from customer group by all) on c_nationkey = n_nationkey group by all")
def agg_category_stats(spark, d):
    frequency = fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("number")).agg(F.count(F.lit(1)).alias("frequency"))
    nation = fx.table(spark, d, "nation").join(sent(fx.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return labels.category_statistics(nation.select(F.col("n_nationkey").alias("number"), F.col("r_name").alias("category")).join(frequency, "number"))


@query("agg_histogram", sql("tok", "select category, label, count(*) as n from tok group by all"))
def agg_histogram(spark, d):
    return fx.tokens(spark, d).groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))


@query("agg_rekey", sql("tok", "select substr(label, 1, 1) as key, cast(sum(n) as bigint) as n from (select label, count(*) as n from tok group by all) group by all"))
def agg_rekey(spark, d):
    return labels.rekey(fx.tokens(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), F.substring("label", 1, 1))


@query("agg_invert", "select r as value, string_agg(cast(k as varchar), ';' order by k) as keys from (select n_regionkey as r, n_nationkey as k from nation) group by all")
def agg_invert(spark, d):
    n = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("value"))
    return labels.invert(n, "k", "value").select("value", F.array_join(F.transform("keys", lambda x: x.cast("string")), ";").alias("keys"))


@query("agg_listagg", "select n_regionkey as region, string_agg(n_name, ';' order by n_name) as names from nation group by all")
def agg_listagg(spark, d):
    return fx.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("names"))


@query("jn_names", sql("res", "select unit, res.label as label, coalesce(n_name, '-') as name from res left join (select 'l' || n_nationkey as label, n_name from nation where n_nationkey < 20) n on res.label = n.label"))
def jn_names(spark, d):
    names = fx.table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("l"), "n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return fx.results(spark, d).select("unit", "label").join(sent(names), "label", "left").withColumn("name", F.coalesce("name", F.lit("-")))


@query("jn_remap", sql("tok voc", "select image, coalesce(number, 0) as number, count(*) as n from tok left join (select label, category, row_number() over (order by frequency desc, coverage desc, label, category) as number from voc) v on tok.label = v.label and tok.category = v.category group by all"))
def jn_remap(spark, d):
    v = vocabulary(spark, d).withColumn("key", F.struct("label", "category"))
    mapping = labels.number_labels(v, "key").select("label", "category", "number")
    return labels.remap(fx.tokens(spark, d), mapping, ["label", "category"]).groupBy("image", "number").agg(F.count(F.lit(1)).alias("n"))


@query("jn_catmap", "select o_orderkey, coalesce(code, 0) as code from orders left join (select p, row_number() over (order by p) as code from (select distinct o_orderpriority as p from orders where o_orderpriority <> '5-LOW')) on p = o_orderpriority")
def jn_catmap(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    codes = numbered(o.where("p <> '5-LOW'").select("p").distinct(), "code", "p")
    return labels.remap(o, codes, ["p"], "code").select("o_orderkey", "code")


@query("jn_fill_dense", "select cast(k as int) as n_nationkey, coalesce(n_name, '') as n_name from range(30) t(k) left join (select * from nation where n_nationkey % 3 = 0) on k = n_nationkey")
def jn_fill_dense(spark, d):
    return labels.fill_dense(fx.table(spark, d, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", "n_name"), "n_nationkey", 29, n_name="")


@query("jn_synonym_claim", "select name, label from (select name, label, row_number() over (partition by name order by frequency desc, label) as rn from (select p_type as name, p_brand as label, count(*) as frequency from part group by all)) where rn = 1")
def jn_synonym_claim(spark, d):
    names = fx.table(spark, d, "part").groupBy(F.col("p_type").alias("name"), F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("frequency"))
    return labels.claims(names)


@query("resolve_names", """with l as (select p_type as key, count(*) as frequency, cast(round(sum(p_size), 2) as double) as coverage from part group by all),
n as (select key, name, frequency, coverage / frequency as size from l join (select distinct p_type as key, p_name as name from part) using (key)),
o as (select name, owner, owner_frequency, owner_size from (select name, key as owner, frequency as owner_frequency, size as owner_size, row_number() over (partition by name order by frequency desc, key) as rn from n) where rn = 1),
own as (select key, min(n.name) as name from n join o on n.name = o.name where owner = key group by key),
lost as (select key, owner from (select key, owner, row_number() over (partition by key order by abs(owner_size - size), owner_frequency desc, owner) as rn from n join o on n.name = o.name where key not in (select key from own)) where rn = 1)
select key as label, name from own union all select lost.key, own.name from lost join own on lost.owner = own.key""")
def resolve_names(spark, d):
    """Part types as labels whose names, those of their parts, overlap."""
    rows = fx.table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.count(F.lit(1)).alias("frequency"), F.round(F.sum("p_size"), 2).cast("double").alias("coverage"))
    return labels.called_names(rows.withColumnRenamed("p_type", "key")).select(F.col("key").alias("label"), "name")


@query("hash_md5_float", "select url, cast('0x' || substr(md5(url), 1, 16) as ubigint) / power(2.0, 64) as h from pages")
def hash_md5_float(spark, d):
    return fx.table(spark, d, "pages").select("url", hashed_unit(F.col("url")).alias("h"))


@query("hash_split", "select page_id, case when cast('0x' || substr(md5(url), 1, 16) as ubigint) / power(2.0, 64) <= 0.7 then 'train' else 'val' end as split from pages")
def hash_split(spark, d):
    return fx.table(spark, d, "pages").select("page_id", labels.split_of(hashed_unit(F.col("url")), [("train", 0.7), ("val", 0.3)]).alias("split"))


@query("srt_hash", "select page_id, row_number() over (order by cast('0x' || substr(md5(url), 1, 16) as ubigint), page_id) as place from pages")
def srt_hash(spark, d):
    h = F.conv(F.substring(F.md5("url"), 1, 16), 16, 10).cast("decimal(20,0)")
    return numbered(fx.table(spark, d, "pages").select("page_id", h.alias("h")), "place", "h", "page_id").select("page_id", "place")


@query("win_cumsplit", "select name, cast(round(sum(share) over (order by ord), 6) as double) as upto from (values (1, 'train', 0.7), (2, 'val', 0.2), (3, 'test', 0.1)) t(ord, name, share)")
def win_cumsplit(spark, d):
    shares = spark.createDataFrame([(1, "train", 0.7), (2, "val", 0.2), (3, "test", 0.1)], "ord int, name string, share double")
    running = F.sum("share").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return shares.select("name", F.round(running, 6).cast("double").alias("upto"))


@query("set_union_sources", "select dataset, count(*) as n from (select 'customer' as dataset from customer union all select 'supplier' from supplier union all select 'nation' from nation) group by all")
def set_union_sources(spark, d):
    parts = {n: fx.table(spark, d, n).select(F.col(f"{n[0]}_name").alias("name")) for n in ("customer", "supplier", "nation")}
    return union(parts).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("win_running_index", "select dataset, name, row_number() over (order by dataset, name) - 1 as idx from (select 'nation' as dataset, n_name as name from nation union all select 'region', r_name from region)")
def win_running_index(spark, d):
    both = union({"nation": fx.table(spark, d, "nation").select(F.col("n_name").alias("name")), "region": fx.table(spark, d, "region").select(F.col("r_name").alias("name"))})
    return numbered(both, "idx", "dataset", "name").withColumn("idx", F.col("idx") - 1)


@query("set_union_parts", sql("tok", "select image, 'seg' as layer, label from tok where label like 'a%' union all select image, 'part', label from tok where label like '%a'"))
def set_union_parts(spark, d):
    t = fx.tokens(spark, d).select("image", "label")
    return t.where("label like 'a%'").withColumn("layer", F.lit("seg")).unionByName(t.where("label like '%a'").withColumn("layer", F.lit("part")))


@query("set_distinct", "select distinct p_type as name from part")
def set_distinct(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()


@query("set_intersect", "select distinct o_orderpriority as name from orders where o_orderpriority in ('1-URGENT', '5-LOW', 'NONE')")
def set_intersect(spark, d):
    wanted = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("NONE",)], "name string")
    return fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name")).intersect(wanted)


@query("set_omit", "select p_partkey, list_aggregate(list_filter(string_split(p_name, ' '), lambda x: x not in ('cold', 'red')), 'string_agg', ' ') as words from part")
def set_omit(spark, d):
    kept = F.array_except(F.split("p_name", " "), F.array(F.lit("cold"), F.lit("red")))
    return fx.table(spark, d, "part").select("p_partkey", F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("words"))


@query("srt_alias", "select name, n, row_number() over (order by n desc, name) as place from (select p_name as name, count(distinct p_brand) as n from part group by all)")
def srt_alias(spark, d):
    n = fx.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("n"))
    return numbered(n, "place", F.desc("n"), "name")


@query("srt_shuffle", "select vec_id, row_number() over (order by md5(vec_id || ' 7'), vec_id) as place from embeddings")
def srt_shuffle(spark, d):
    """A seeded shuffle that depends on the rows alone, not on how they are dealt out: the order of their hashes with the seed."""
    rows = fx.table(spark, d, "embeddings").select("vec_id", F.md5(F.concat_ws(" ", "vec_id", F.lit(7))).alias("h"))
    return numbered(rows, "place", "h", "vec_id").select("vec_id", "place")


@query("lim_head", "select page_id, url from pages order by page_id limit 20")
def lim_head(spark, d):
    return fx.table(spark, d, "pages").select("page_id", "url").orderBy("page_id").limit(20)


@query("lim_depth", sql("tok", "select image, label from (select image, label, row_number() over (partition by image order by n desc, label) as rn from (select image, label, count(*) as n from tok group by all)) where rn <= 3"))
def lim_depth(spark, d):
    n = fx.tokens(spark, d).groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("n"), "label"))).where("rn <= 3").select("image", "label")
