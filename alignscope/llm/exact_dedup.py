"""Exact deduplication by two passes of Bloom filtering.

Pass 1 hashes every text and finds the digests (60 bits of each, 8 bytes a row) that occur more than once; these go into
a Bloom filter of ``BITS`` bits each. Pass 2 tests every row's digest where the row stands: what the filter doesn't hold
occurs once and passes straight through. Only the rest shuffles, keyed by its SHA-256. The filter has no false negatives,
and false positives only cost the shuffle of a row, so the result is exact for any size of the filter.

The filter is sent to every task in dense blocks. One that is larger than ``filter_bytes`` is split by ranges of digests,
and pass 2 is made range by range, so that no task ever holds more and no row without a possible copy is ever shuffled;
a cluster with more memory can take a larger bound and so fewer ranges. The default holds the repeated digests of some
300 million rows.

Defined cases: a null text counts as empty, and empty texts are equal to each other; texts of any length are compared
whole, after each run of ASCII white space has become one space; of equal texts the row with the smallest doc_id stays (a
null doc_id is smaller than any other; of equal ids the row with the smaller text as it came, and of wholly equal ones
any one); an empty table gives no rows; other columns, whatever they are called, are carried through unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WHITE, cut, fresh, join_groups, named, sha256_text

#: Bits of the filter for each repeated digest, slots that a digest sets, and words of 64 bits in a block.
BITS, HASHES, BLOCK = 16, 2, 64
#: Bytes that a block takes where it is looked up, with its key.
BLOCK_BYTES = 8 * BLOCK + 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _digest(sha: str) -> Column:
    """60 bits of a SHA-256 in hex."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def repeated_digests(hashed: DataFrame, sha: str) -> DataFrame:
    """Pass 1: digest, for all that occur more than once."""
    return hashed.groupBy(_digest(sha).alias("digest")).agg(F.count(F.lit(1)).alias("hits")).where("hits > 1").select("digest")


def _slot(digest: Column, k: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(slots))


def filter_blocks(digests: DataFrame, slots: int) -> DataFrame:
    """The filter: block, words array<long>. Blocks without a bit are left out."""
    slot = F.explode(F.array(*[_slot(F.col("digest"), k, slots) for k in range(HASHES)])).alias("slot")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = digests.select(slot).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy(F.floor(F.col("word") / BLOCK).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % BLOCK).cast("int").alias("at"), "bits"))).alias("held"))
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long"))).alias("words"))


def _tested(rows: DataFrame, sha: str, blocks: DataFrame, slots: int, out: str) -> DataFrame:
    """``rows`` with a column that is false where the filter says that the digest occurs once."""
    columns, hit = [named(c) for c in rows.columns], F.lit(True)
    for k in range(HASHES):
        block, words = fresh(rows, f"block{k}", f"words{k}")
        slot = _slot(_digest(sha), k, slots)
        rows = rows.withColumn(block, F.floor(slot / (64 * BLOCK))).join(F.broadcast(blocks.select(F.col("block").alias(block), F.col("words").alias(words))), block, "left")
        word = F.get(F.col(words), (F.floor(slot / 64) % BLOCK).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
        hit = hit & F.coalesce(word.bitwiseAND(bit) != 0, F.lit(False))
    return rows.select(*columns, hit.alias(out))


def passes(rows: DataFrame, sha: str, repeated: DataFrame, out: str, filter_bytes: int) -> Iterator[DataFrame]:
    """Pass 2 over each range of digests: ``rows`` of the range, tested."""
    n = repeated.count()
    ranges = max(1, math.ceil(n * BITS / 8 * BLOCK_BYTES / (8 * BLOCK) / max(filter_bytes, 1)))
    slots = max(64 * BLOCK, math.ceil(n / ranges) * BITS)
    for r in range(ranges):
        own = lambda digest: F.pmod(digest, F.lit(ranges)) == r  # noqa: E731, B023
        some, digests = (rows, repeated) if ranges == 1 else (rows.where(own(_digest(sha))), repeated.where(own(F.col("digest"))))
        tested = _tested(some, sha, cut(filter_blocks(digests, slots)), slots, out)
        # one filter at a time: the rows of a range are written before the next filter is sent
        yield tested if ranges == 1 else cut(tested)


def label_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One narrow row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = docs.select(named(doc_id).cast("long").alias("doc_id"), sha256_text(normalised(named(text).cast("string"))).alias("text_sha256"))
    hashed = cut(hashed.withColumn("rid", F.monotonically_increasing_id()))
    total = hashed.count()
    out = []
    for tested in passes(hashed, "text_sha256", cut(repeated_digests(hashed, "text_sha256")), "maybe", filter_bytes):
        alone = tested.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
        again = tested.where("maybe").drop("maybe")
        groups = again.groupBy("text_sha256").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        met = join_groups(again, groups, "text_sha256", "group_size", total)
        out.append(alone.unionByName(met.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")))
    return reduce(DataFrame.unionByName, out)


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    The whole rows are tested against the filter where they stand; only rows whose digest may repeat are shuffled.
    """
    sha, maybe, first = fresh(docs, "sha", "maybe", "first")
    columns = [named(c) for c in docs.columns]
    digest = sha256_text(normalised(named(text).cast("string")))
    repeated = cut(repeated_digests(docs.select(digest.alias("s")), "s"))
    out = []
    for tested in passes(docs.withColumn(sha, digest), sha, repeated, maybe, filter_bytes):
        alone = tested.where(~F.col(maybe)).select(*columns)
        groups = tested.where(F.col(maybe)).groupBy(sha).agg(F.min_by(F.struct(*columns), F.struct(named(doc_id), named(text))).alias(first))
        out.append(alone.unionByName(groups.select(f"{first}.*")))
    return reduce(DataFrame.unionByName, out)
