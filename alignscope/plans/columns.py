"""Queries that apply column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, text
from . import fixtures as fx
from .registry import query

PART = "select p_partkey, {} as name from part"


def _part(spark, d, column):
    return fx.table(spark, d, "part").select("p_partkey", column.alias("name"))


@query("str_norm_name", PART.format("lower(trim(replace(replace(' ' || p_name || ' - X/' || p_type || ' ', ' - ', '-'), '/', '-')))"))
def str_norm_name(spark, d):
    return _part(spark, d, text.norm_name(F.concat(F.lit(" "), "p_name", F.lit(" - X/"), "p_type", F.lit(" "))))


@query("str_fix", PART.format("replace(regexp_replace(replace(p_name, ' ', '_') || case when p_partkey % 2 = 0 then '-s' else '-c' end, '-[sc]$', ''), '_', ' ')"))
def str_fix(spark, d):
    return _part(spark, d, text.fix_label(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, "-s").otherwise("-c"))))


@query("str_print_label", PART.format("regexp_replace(translate(left(n, greatest(length(n) - 2, 0)), '_-', '  ') || right(n, least(2, length(n))), '-[sc]', '', 'g')").replace("from part", "from (select p_partkey, replace(p_name, ' ', '_') || '-s' as n from part)"))
def str_print_label(spark, d):
    return _part(spark, d, text.print_label(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-s"))))


@query("str_fn_safe", PART.format("trim(regexp_replace(p_name || '/' || p_type || '!', '[^\\w]+', '-', 'g'), '-')"))
def str_fn_safe(spark, d):
    return _part(spark, d, text.file_safe(F.concat("p_name", F.lit("/"), "p_type", F.lit("!")), dot_free=True))


@query("str_print_net", "select r_regionkey, case r_regionkey when 0 then 'AlexNet-Places205' when 1 then 'VGG-ImageNet' else r_name end as name from region")
def str_print_net(spark, d):
    stored = F.when(F.col("r_regionkey") == 0, F.lit("ref_alexnet_places")).when(F.col("r_regionkey") == 1, F.lit("ref_vgg16_imagenet")).otherwise(F.col("r_name"))
    return fx.table(spark, d, "region").select("r_regionkey", text.print_network(stored).alias("name"))


@query("str_synonyms", PART.format("p_name || case when starts_with(p_name, 'cold') then ',chilly' when starts_with(p_name, 'red') then ',scarlet' else '' end"))
def str_synonyms(spark, d):
    first = F.element_at(F.split("p_name", " "), 1)
    names = F.array(F.col("p_name"), F.concat(F.lit("~"), first), F.lit("thing"))
    return _part(spark, d, F.array_join(F.filter(text.synonyms(names, {"~cold": ["chilly", "thing"], "~red": ["scarlet"]}, ["thing"]), lambda x: ~F.startswith(x, F.lit("~"))), ","))


@query("str_collapse_adj", PART.format("trim(regexp_replace(regexp_replace(p_name, '^(cold|red|blue) ', ''), 'widget', 'gadget'))"))
def str_collapse_adj(spark, d):
    return _part(spark, d, text.collapse_adjectives(F.split("p_name", " "), ["cold", "red", "blue"], {"widget": "gadget"}))


@query("str_split_names", "select p_partkey, cast(len(list_filter(regexp_split_to_array(p_name || ', ' || p_type || ',' || p_brand, ',\\s*'), lambda x: x <> '')) as int) as n from part")
def str_split_names(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", F.size(text.split_names(F.concat("p_name", F.lit(", "), "p_type", F.lit(","), "p_brand"))).alias("n"))


@query("str_suffix_cat", "select o_orderkey, o_orderstatus || case o_orderpriority when '1-URGENT' then '-c' when '2-HIGH' then '-s' else '' end as name from orders")
def str_suffix_cat(spark, d):
    category = F.when(F.col("o_orderpriority") == "1-URGENT", "color").when(F.col("o_orderpriority") == "2-HIGH", "scene").otherwise("object")
    return fx.table(spark, d, "orders").select("o_orderkey", text.suffixed(F.col("o_orderstatus"), category).alias("name"))


@query("str_parse_catmap", "select n_nationkey, n_regionkey as color, n_nationkey as object from nation")
def str_parse_catmap(spark, d):
    counts = F.array(F.struct(F.lit("color").alias("name"), F.col("n_regionkey").alias("n")), F.struct(F.lit("object").alias("name"), F.col("n_nationkey").alias("n")))
    parsed = fx.table(spark, d, "nation").select("n_nationkey", text.parse_category_counts(text.print_category_counts(counts)).alias("m"))
    return parsed.select("n_nationkey", F.col("m")["color"].alias("color"), F.col("m")["object"].alias("object"))


@query("str_file_variants", "select page_id, 'p' || page_id || '_seg.png' as seg, 'p' || page_id || '_color.png' as first_file, 'p' || page_id || '_color_2.png' as third_file from pages")
def str_file_variants(spark, d):
    image = F.concat(F.lit("p"), F.col("page_id"), F.lit(".jpg"))
    named = lambda n: text.category_file(image, F.lit("color"), F.lit(n))
    return fx.table(spark, d, "pages").select("page_id", text.seg_file(image).alias("seg"), named(0).alias("first_file"), named(2).alias("third_file"))


@query("math_round_red", "select o_orderkey, cast(round((o_orderkey % 500 + 1) / 37.0) as int) as reduction from orders")
def math_round_red(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", F.round((F.col("o_orderkey") % 500 + 1) / 37.0).cast("int").alias("reduction"))


@query("math_interp", "select event_type, round(quantile_cont(value, 0.1), 6) as q10, round(quantile_cont(value, 0.37), 6) as q37, round(quantile_cont(value, 0.995), 6) as q995 from events group by all")
def math_interp(spark, d):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return fx.table(spark, d, "events").groupBy("event_type").agg(q(0.1).alias("q10"), q(0.37).alias("q37"), q(0.995).alias("q995"))


@query("codec_rg", "select l_orderkey, l_linenumber, l_partkey, cast(l_partkey % 256 as int) as r, cast(l_partkey // 256 as int) as g, cast(l_partkey as int) as back from lineitem")
def codec_rg(spark, d):
    r, g = codec.red(F.col("l_partkey")), codec.green(F.col("l_partkey"))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r.alias("r"), g.alias("g"), codec.label_of(r, g).alias("back"))


@query("agg_mean_pixel", "select user_id % 3 as channel, round(avg(value), 6) as mean from events group by all")
def agg_mean_pixel(spark, d):
    return fx.table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("channel")).agg(F.round(F.avg("value"), 6).alias("mean"))
