"""The queries of this package, by name: thin layers that read a whole table and derive the contracts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, html_extract, jaccard_join, language_id, license_scan, packing, quality_rules, weak_quality
from .common import sha256_text, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory per source and language, and one below it for every thousand documents."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    path = F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 1000)), F.concat(part(F.col("doc_id")), F.lit(".txt")))
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_near(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_quality.score(docs, weak_quality.train(docs))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(language_id.held_out(), F.lit(False))
    model = language_id.train(docs.where(~held))
    named = language_id.classify(docs, model)
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digest_documents(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat_format.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    back = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_text(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_text(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_html_extract, op3_packing, op4_license_scan, op5_quality_rules, op6_jaccard_join, op7_quality_classifier, op8_language_id, op9_byte_bpe, op10_chat_format)}

_COPIES = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""

_RULES = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t from documents),
s as (select rid, doc_id, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
x as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from s where len(w) > 2)),
r as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by rid, a, b, c) as n from x) where n > 1) group by rid),
f as (select s.rid, doc_id, host, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, n_symbols,
      len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from s left join r on s.rid = r.rid),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols > 0.5 * n_words or n_dup_lines > 0.5 * n_lines as soft_failed from f),
h as (select host, count(*) as n, cast(sum(cast(base_failed or soft_failed as int)) as bigint) as bad from b group by host),
m as (select cast(sum(bad) as double) / cast(sum(n) as double) as mean, greatest(sum(cast(bad as double) * bad / n) / cast(sum(n) as double) - (cast(sum(bad) as double) / cast(sum(n) as double)) ** 2, 1e-9) as variance from h),
k as (select mean, greatest(1.0, least(1000.0, mean * (1 - mean) / variance - 1)) as strength from m),
v as (select host, (bad + mean * strength) / (n + strength) as rate from h, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and rate < 0.6 and not (soft_failed and rate >= 0.05) as kept, round(rate, 9) as host_rate
from b join v on b.host = v.host
"""

_CHATS = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
      union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l as (select *, lag(role) over (partition by conv_id order by turn, role, t) is not distinct from role as merged,
      length(t) + len(regexp_extract_all(t, '\\')) + len(regexp_extract_all(t, '[<\[](?:\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>|/?bos>|/?eos>|start_of_turn>|end_of_turn>)')) as escaped from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) as turns_sha256,
       cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(escaped + case when merged then 11 else 12 + length(role) + 1 + 11 end) as bigint) as formatted_chars
from l group by conv_id
"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": _COPIES, "op5_quality_rules": _RULES, "op10_chat_format": _CHATS}
