"""Document rules and host verdicts, with DataFrame expressions only.

Every document gets five counts and the rules that it fails. Failures are summed by host, each host's failure rate is
shrunk with a beta prior fitted to all hosts by moments, and the shrunk rate decides for the host: trusted, doubtful or
rejected. The verdict is joined back: a rejected host loses all its documents, a doubtful one those that fail any rule,
a trusted one those alone that fail a base rule.

Defined cases: a null or empty text has no words and so fails the base rule; a null host is a host of its own; repeated
rows are counted and returned each, and rules look at one document only, so ties need no rule; texts of any length are
read whole; an empty table gives no rows; other columns, whatever they are called, are ignored or carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, fits_broadcast, fresh, join_groups, named

#: The characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Softer rules: symbols a word, and the share of lines that repeat.
MAX_SYMBOLS_A_WORD, MAX_DUP_LINE_SHARE = 0.5, 0.5
#: Shrunk failure rates from which a host is doubtful and rejected.
DOUBTFUL, REJECTED = 0.05, 0.6
WINDOW = 3


def _windows(words: Column) -> Column:
    return F.size(words) - (WINDOW - 1)


def _repeat_words(words: Column, keys: Column) -> Column:
    """Words covered by windows found twice or more.

    ``keys`` are sorted structs (hash, at) of all windows. Neighbours with one hash are the candidates; they are sorted
    again by the words themselves, so a collision of hashes can't count. Both sorts are n log n in the text's words.
    """
    near = F.filter(keys, lambda k, i: (F.get(keys, i - 1)["h"] == k["h"]) | (F.get(keys, i + 1)["h"] == k["h"]))
    exact = F.sort_array(F.transform(near, lambda k: F.struct(F.get(words, k["at"]).alias("a"), F.get(words, k["at"] + 1).alias("b"), F.get(words, k["at"] + 2).alias("c"), k["at"].alias("at"))))
    return exact


def _same(x: Column, y: Column) -> Column:
    return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (names start with ``prefix``)."""
    body, words, keys, exact, ats, lines = fresh(docs, "body", "words", "keys", "exact", "ats", "lines")
    keep = [named(c) for c in docs.columns]
    at = lambda name: F.col(name)
    df = docs.withColumn(body, F.coalesce(named(text), F.lit("")))
    df = df.withColumns({words: F.filter(F.split(body, WHITE), lambda w: w != ""), lines: F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))})
    firsts = F.when(_windows(at(words)) > 0, F.sequence(F.lit(0), _windows(at(words)) - 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(firsts, lambda i: F.struct(F.xxhash64(F.get(at(words), i), F.get(at(words), i + 1), F.get(at(words), i + 2)).alias("h"), i.alias("at")))
    df = df.withColumn(keys, F.sort_array(hashes))
    df = df.withColumn(exact, _repeat_words(at(words), at(keys)))
    twice = F.filter(at(exact), lambda x, i: F.coalesce(_same(F.get(at(exact), i - 1), x), F.lit(False)) | F.coalesce(_same(F.get(at(exact), i + 1), x), F.lit(False)))
    df = df.withColumn(ats, F.sort_array(F.transform(twice, lambda x: x["at"])))
    gaps = F.transform(at(ats), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at(ats), i + 1) - p, F.lit(WINDOW))))
    return df.select(
        *keep,
        F.size(words).cast("long").alias(f"{prefix}n_words"),
        F.length(F.array_join(words, "")).cast("long").alias(f"{prefix}word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias(f"{prefix}n_symbols"),
        F.size(lines).cast("long").alias(f"{prefix}n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{prefix}n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g).alias(f"{prefix}n_repeat_words"),
    )


def base_failed(p: str = "") -> Column:
    return (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))


def soft_failed(p: str = "") -> Column:
    return (F.col(f"{p}n_symbols") > MAX_SYMBOLS_A_WORD * F.col(f"{p}n_words")) | (F.col(f"{p}n_dup_lines") > MAX_DUP_LINE_SHARE * F.col(f"{p}n_lines"))


def host_verdicts(failures: DataFrame) -> DataFrame:
    """failures: host, failed boolean, one row per document -> host, n, rate, verdict (0 trusted, 1 doubtful, 2 rejected).

    The prior is fitted by moments: its mean is the failure rate of all documents, its strength follows from the
    variance of the hosts' rates, weighted by their documents.
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    total = hosts.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("squares"))
    sums = total.first()  # three numbers
    mean = (sums["all_bad"] or 0) / (sums["all_n"] or 1)
    variance = max((sums["squares"] or 0.0) / (sums["all_n"] or 1) - mean * mean, 1e-9)
    strength = max(1.0, min(1000.0, mean * (1 - mean) / variance - 1))
    rates = hosts.withColumns({"mean": F.lit(mean), "strength": F.lit(strength)})
    rates = rates.withColumn("rate", (F.col("bad") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))
    return rates.select("host", "n", "rate", F.when(F.col("rate") >= REJECTED, 2).when(F.col("rate") >= DOUBTFUL, 1).otherwise(0).alias("verdict"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row per document: doc_id, the counts, base_failed, kept, host_rate."""
    counted = cut(with_counts(docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(host), F.lit("\0")).alias("host"), named(text).alias("text"))).drop("text"))
    failed = counted.select("host", (base_failed() | soft_failed()).alias("failed"))
    verdicts = host_verdicts(failed)
    met = join_groups(counted, verdicts, "host", "n", counted.count())
    kept = ~base_failed() & (F.col("verdict") < 2) & ~(soft_failed() & (F.col("verdict") == 1))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"), F.col("rate").alias("host_rate"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, with their own columns.

    Texts are counted once; the rows are written with two bits beside them. No text is shuffled unless the table of
    doubtful and rejected hosts is too large to broadcast.
    """
    name, verdict, n, base, soft, p = fresh(docs, "host", "verdict", "n", "base", "soft", "c")
    columns = [named(c) for c in docs.columns]
    counted = with_counts(docs.withColumn(name, F.coalesce(named(host), F.lit("\0"))), text, prefix=p)
    counted = cut(counted.select(*columns, name, base_failed(p).alias(base), soft_failed(p).alias(soft)))
    verdicts = cut(host_verdicts(counted.select(F.col(name).alias("host"), (F.col(base) | F.col(soft)).alias("failed"))).where("verdict > 0"))
    verdicts = verdicts.select(F.col("host").alias(name), F.col("n").alias(n), F.col("verdict").alias(verdict))
    counted = counted.where(~F.col(base))
    if fits_broadcast(verdicts.count(), 128):
        met = counted.join(F.broadcast(verdicts), name, "left")
    else:
        met = join_groups(counted, verdicts, name, n, counted.count())
    bad = F.coalesce(F.col(verdict), F.lit(0))
    return met.where((bad < 2) & ~(F.col(soft) & (bad == 1))).select(*columns)
