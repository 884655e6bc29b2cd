"""Jaccard self-join of documents on word shingles, by the chosen-path method.

1. Every text becomes its set of hashes of five words running (a shorter text is one shingle), a 64-bit key of that set
   and 128 minhash values, 'tokens' that two sets share with a chance equal to their Jaccard similarity. Documents with
   one key have one set; they are a class and go on as one.
2. Each run splits the classes on tokens that a hash samples: a class follows ``REACH / (THRESHOLD * TOKENS)`` of its
   tokens, each into the bucket named by run and token, so two classes at the threshold share ``REACH`` buckets on
   average. Buckets of over ``BUCKET`` classes are split again on further sampled tokens; those that are still larger
   at level ``DEPTH`` are dealt out in chunks, and all pairs of chunks are compared, so none is cut off. The number of
   runs follows from the target recall by the extinction chance of such a branching process.
3. Small buckets are compared by brute force on minhash values, with a margin of four standard deviations; classes that
   are known to belong together aren't compared again, so a bucket of near copies costs little more than one pass. What
   is linked so is joined to candidate groups (connected components, found without collecting them).
4. Every candidate group is verified exactly: its classes' whole shingle sets meet once, in blocks of bounded size, and
   all pairs of the group are decided by their true Jaccard similarity. Blocks return one row a class (how many
   documents it is linked to, and a label of its part), never pairs.

A class's links count all documents of all classes with similarity of at least ``THRESHOLD``, and its own copies.

Of a group of c classes in blocks of B every class's set is read c / B times, as exact link counts need every pair of the
group; nothing is emitted per pair.

Defined cases: texts without a word (null, empty, white space) have no shingles, are like nothing, and stay alone; a
null doc_id is treated as the smallest; of rows that share a doc_id the one whose text has the lowest hash comes first,
and of wholly repeated rows one stays in ``drop_near_copies``; texts of any length are read whole; an empty table gives
no rows; other columns, whatever they are called, are ignored or carried through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import filled, give_back, slices
from .common import Tables, cut, fits_broadcast, fresh, join_groups, named
from .components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
THRESHOLD = NUMERATOR / DENOMINATOR
TOKENS, REACH, RECALL = 128, 1.6, 0.9999
BUCKET, DEPTH = 4096, 3
#: Estimated similarity from which two classes are candidates: four standard deviations below the threshold.
NEAR = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)
#: Classes and shingles in a block of the verification.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 21
NO_ID = -(2**63)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CHANCE = REACH / (THRESHOLD * TOKENS)


def runs_for(recall: float = RECALL) -> int:
    """Runs after which two classes at the threshold have met with this chance, however deep buckets are split."""
    lost = 0.0
    for _ in range(1000):
        lost = math.exp(-REACH * (1 - lost))
    return math.ceil(math.log(1 - recall) / math.log(lost))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


_FACTORS = _mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64)
    real = np.array([n != "" for n in names], bool)
    numbers, offsets = coded.indices.to_numpy(), np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    out = []
    for k in range(len(texts)):
        own = numbers[offsets[k] : offsets[k + 1]]
        w = hashes[own[real[own]]] if len(own) else hashes[:0]
        if not len(w):
            out.append(w)
            continue
        m = max(1, len(w) - WORDS + 1)
        h = np.zeros(m, np.uint64)
        for i in range(min(WORDS, len(w))):
            h = h * np.uint64(0x9FB21C651E98DF25) + w[i : i + m]
        out.append(np.unique(_mix(h)))
    return out


def set_key(s: np.ndarray) -> int:
    """64 bits of a set, as a signed integer."""
    total = np.add.reduce(_mix(s), keepdims=True) ^ (np.full(1, len(s), np.uint64) * _M1)
    return int(_mix(total + np.bitwise_xor.reduce(s)).view(np.int64)[0])


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The minhash values of sets that aren't empty, mixed."""
    sizes = np.array([len(s) for s in sets])
    starts, every = np.cumsum(sizes) - sizes, np.concatenate(sets)
    out = np.empty((len(sets), TOKENS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(every * factor, starts)
    return _mix(out)


def identity(text: str, doc_id: str) -> list[Column]:
    """What tells rows apart: the id, and a hash of the text for rows whose id repeats or is null."""
    return [F.coalesce(named(doc_id).cast("long"), F.lit(NO_ID)), F.xxhash64(named(text).cast("string"))]


def identified(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    ids, body = identity(text, doc_id)
    return docs.select(ids.alias("doc_id"), body.alias("body"), named(text).cast("string").alias("text"))


def sketches(docs: DataFrame, text: str, doc_id: str, runs: int) -> DataFrame:
    """doc_id, body (hash of the text), key (null without shingles), n (shingles), sig (8 bits of each minhash value), nodes
    (the first buckets).

    The first buckets are named by whole minhash values: with 8 bits of them, unlike sets would share buckets by chance,
    and ever more often as the corpus grows. Inside a bucket 8 bits are enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(2))
            for a, b in slices(texts):
                sets = shingle_sets(texts.slice(a, b - a))
                full = [s for s in sets if len(s)]
                values = minhashes(full) if full else np.zeros((0, TOKENS), np.uint64)
                sig, nodes = iter((values >> np.uint64(56)).astype(np.uint8)), iter(first_buckets(values, runs))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(nodes) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "body", "key", "n", "sig", "nodes"],
                )
        give_back()

    return identified(docs, text, doc_id).mapInArrow(run, "doc_id long, body long, key long, n long, sig binary, nodes array<long>")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _follow(tokens: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled tokens' buckets below ``above``, and the row of each; tokens are 64-bit values, one column each."""
    h = _mix((tokens ^ (np.arange(TOKENS, dtype=np.uint64) << np.uint64(56))) * _M2 ^ above[:, None])
    row, col = np.nonzero(h < np.uint64(int(_CHANCE * 2**64)))
    return _mix(h[row, col] + _M1).view(np.int64), row


def first_buckets(values: np.ndarray, runs: int) -> list[np.ndarray]:
    """For each set the buckets that it enters in any of the runs."""
    found = [_follow(values, np.full(len(values), r + 1, np.uint64)) for r in range(runs)]
    row = np.concatenate([r for _, r in found]) if found else np.array([], np.int64)
    order = np.argsort(row, kind="stable")
    node = np.concatenate([n for n, _ in found])[order] if found else np.array([], np.int64)
    ends = np.searchsorted(row[order], np.arange(len(values) + 1))
    return [node[ends[k] : ends[k + 1]] for k in range(len(values))]


def split_buckets(members: DataFrame) -> DataFrame:
    """members: key, sig, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                node, row = _follow(_signatures(part.column(1)).astype(np.uint64), part.column(2).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(part.column(0).to_numpy()[row])], ["node", "key"])

    return members.select("key", "sig", "node").mapInArrow(run, "node long, key long")


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the named columns, from sorted batches; each run is whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != x for c, x in zip(columns, last, strict=True))
        last = [c[-1] for c in columns]
        cuts = np.flatnonzero(change).tolist()
        a = 0
        for b in cuts:
            if b > a:
                held.append(batch.slice(a, b - a))
            yield pa.Table.from_batches(held)
            held, a = [], b
        held.append(batch.slice(a))
    if held:
        yield pa.Table.from_batches(held)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each part of a graph on 0 to n - 1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def brute_force(members: DataFrame) -> DataFrame:
    """members: node, key, sig, dealt by node -> links a, b of a forest over what is near within each bucket."""

    def parts(sig: np.ndarray) -> np.ndarray:
        """For each row the number of the first row of its part."""
        label = np.arange(len(sig))
        need = NEAR * TOKENS
        for i in range(len(sig) - 1):
            other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if not len(other):
                continue
            met = label[other[np.count_nonzero(sig[other] == sig[i], axis=1) >= need]]
            if len(met):
                old = np.unique(np.append(met, label[i]))
                label[np.isin(label, old)] = old[0]
        return label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for group in groups_of(batches, ["node"]):
            if group.num_rows < 2:
                continue
            keys = group.column("key").to_numpy()
            sig = _signatures(group.column("sig").combine_chunks())
            if len(keys) == 2:
                if np.count_nonzero(sig[0] == sig[1]) >= NEAR * TOKENS:
                    found.add((int(keys[0]), int(keys[1])))
            else:
                label = parts(sig)
                found.update((int(keys[i]), int(keys[label[i]])) for i in np.flatnonzero(label != np.arange(len(keys))))
            if len(found) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
                found = set()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _met(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Inner join on node with one row per node (node, size, ...), which every task gets if it fits."""
    if fits_broadcast(groups.count(), 48):
        return rows.join(F.broadcast(groups), "node")
    return join_groups(rows, groups, "node", "size", total).where("size is not null")


def _shared(level: DataFrame, total: int, tables: Tables) -> DataFrame:
    """node, key, size of the buckets with several classes; of buckets with the same classes, one."""
    sizes = tables.cut(level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = tables.cut(_met(level, sizes, total))
    tables.drop(sizes)
    # two independent hashes of the set of classes, and its size, stand for the set
    marks = members.groupBy("node").agg(F.first("size").alias("size"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x"), F.sum(F.xxhash64("key", F.lit(2)).bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
    single = tables.cut(marks.groupBy("size", "x", "s").agg(F.min("node").alias("node")).select("node", F.col("size").alias("size")))
    out = tables.cut(_met(members.drop("size"), single, total).select("node", "key", "size"))
    tables.drop(members)
    tables.drop(single)
    return out


def _signed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """node, key, sig. A few members go to the classes, not all classes to the members."""
    signatures = classes.select("key", "sig")
    small = fits_broadcast(members.count(), 48)
    return signatures.join(F.broadcast(members) if small else members, "key").select("node", "key", "sig")


def candidate_links(classes: DataFrame, total: int, tables: Tables) -> DataFrame:
    """Links a, b whose components hold every pair of similar classes, up to the recall."""
    level = classes.select(F.explode("nodes").alias("node"), "key")
    links = []
    for depth in range(1, DEPTH + 1):
        members = _shared(level, total, tables)
        small = members.where(F.col("size") <= BUCKET).select("node", "key")
        large = members.where(F.col("size") > BUCKET).select("node", "key", "size")
        more = not large.isEmpty()
        if more and depth == DEPTH:
            # chunks of half a bucket; each class goes to every pair of chunks that its own is part of
            chunks = F.ceil(F.col("size") / (BUCKET / 2)).cast("int")
            own = large.select("node", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("key", F.lit(5)), chunks).cast("int").alias("own"))
            each = own.select("node", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
            small = small.unionByName(each.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "key"))
            more = False
        dealt = _signed(small, classes).repartition(F.col("node")).sortWithinPartitions("node")
        links.append(tables.cut(brute_force(dealt)))
        if not more:
            break
        level = tables.cut(split_buckets(_signed(large.select("node", "key"), classes)))
    return reduce(DataFrame.unionByName, links)


def _verify(keys: np.ndarray, sizes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each class the documents that it is linked to here, and the number of the first class of its part."""
    n = len(keys)
    lens = np.array([len(s) for s in sets], np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), lens.astype(np.int64))
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    at, owner = column[number[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((n, n), np.float32)
    width = 2048
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, [first, first + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], at[a:b] - first] = 1
        both += m @ m.T
    linked = both * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (lens[:, None] + lens[None, :])
    np.fill_diagonal(linked, False)
    if cross:
        linked &= sides[:, None] != sides[None, :]
    return linked @ sizes, _labels(n, *np.nonzero(np.triu(linked)))


def verify(docs: DataFrame, classes: DataFrame, groups: DataFrame, text: str, doc_id: str, tables: Tables) -> DataFrame:
    """groups: key, comp -> key, links, label, parts (blocks of its group)."""
    members = tables.cut(groups.join(classes.select("key", "doc_id", "body", "size", "n"), "key"))
    total = members.count()
    blocks = members.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    blocks = blocks.select("comp", "c", F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    met = join_groups(members, blocks, "comp", "c", total)
    dealt = tables.cut(met.select("key", "doc_id", "body", "size", "comp", "parts", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int").alias("part")))
    small = fits_broadcast(total, 72)
    met = identified(docs, text, doc_id).join(F.broadcast(dealt) if small else dealt, ["doc_id", "body"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = filled(batch.column(0))
            for a, b in slices(words):
                sets = shingle_sets(words.slice(a, b - a))
                part = batch.slice(a, b - a)
                keep = [k for k, (s, key) in enumerate(zip(sets, part.column(1).to_pylist(), strict=True)) if len(s) and set_key(s) == key]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int32())) for c in part.columns[1:]), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["key", "size", "comp", "parts", "part", "shingles"])
        give_back()

    sets = met.select("text", "key", "size", "comp", "parts", "part").mapInArrow(read, "key long, size long, comp long, parts int, part int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = sets.select("*", other).select("*", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).drop("other")
    pairs = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "key")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["comp", "i", "j"]):
            keys = group.column("key").to_numpy()
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]  # repeated rows of one document
            group = group.filter(pa.array(first))
            keys = group.column("key").to_numpy()
            sides = group.column("part").to_numpy()
            cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            rows = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            links, label = _verify(keys, group.column("size").to_numpy().astype(np.float64), sides, rows, cross)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(links.astype(np.int64)), pa.array(keys[label]), group.column("parts").combine_chunks()], ["key", "links", "label", "parts"])

    return pairs.mapInArrow(decide, "key long, links long, label long, parts int")


def _classed(docs: DataFrame, text: str, doc_id: str, recall: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, body, class_id, class_body (of the first row of its class), n_links, copies."""
    with Tables(docs.sparkSession) as tables:
        drawn = tables.cut(sketches(docs, text, doc_id, runs_for(recall)))
        total = drawn.count()
        grouped = drawn.where(F.col("key").isNotNull()).groupBy("key")
        classes = grouped.agg(F.first("sig").alias("sig"), F.first("nodes").alias("nodes"), F.first("n").alias("n"), F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "body")).alias("first"))
        classes = tables.cut(classes.select("key", "sig", "nodes", "n", "size", "first.*"))
        groups = components(candidate_links(classes, total, tables), tables).select(F.col("node").alias("key"), F.col("label").alias("comp"))
        decided = tables.cut(verify(docs, classes, groups, text, doc_id, tables))
        links = decided.groupBy("key").agg(F.sum("links").alias("links"))
        whole = decided.where("parts = 1").select("key", "label")
        split = decided.where("parts > 1")
        if not split.isEmpty():
            # the parts of a group that was decided in blocks meet by their common classes
            met = components(split.select(F.col("key").alias("a"), F.col("label").alias("b")), tables).select(F.col("node").alias("key"), "label")
            alone = split.select("key").distinct().join(met.select("key"), "key", "left_anti")
            whole = whole.unionByName(met).unionByName(alone.select("key", F.col("key").alias("label")))
        known = tables.cut(whole.join(classes.select("key", "doc_id", "body"), "key"))
        lowest = known.groupBy("label").agg(F.min(F.struct("doc_id", "body")).alias("lowest"), F.count(F.lit(1)).alias("c"))
        of_group = join_groups(known.select("key", "label"), lowest, "label", "c", total).select("key", "lowest").join(links, "key")
        info = classes.select("key", "size", F.struct("doc_id", "body").alias("own")).join(of_group, "key", "left")
        info = info.select("key", "size", F.coalesce("lowest", "own").alias("lowest"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
        info = tables.cut(info.where("size > 1 or n_links > 0"))
        out = join_groups(drawn.select("doc_id", "body", "key"), info, "key", "size", total)
        return cut(
            out.select(
                "doc_id",
                "body",
                F.coalesce("lowest.doc_id", "doc_id").alias("class_id"),
                F.coalesce("lowest.body", "body").alias("class_body"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("size", F.lit(1)).cast("long").alias("copies"),
            )
        )


def join_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copies.

    class_id is the smallest doc_id of all documents that links connect with it; n_links is the number of documents
    with similarity of at least the threshold; copies is the number of documents with the same shingles.
    """
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return _classed(docs, text, doc_id, recall).select(real("doc_id"), real("class_id"), "n_links", "copies")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the first, by doc_id."""
    names = fresh(docs, "near_id", "near_body")
    keys = [F.col(a).alias(b) for a, b in zip(("doc_id", "body"), names, strict=True)]
    classed = _classed(docs, text, doc_id, recall)
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("body") == F.col("class_body"))
    gone = classed.where(~first).select(*keys).distinct()
    small = fits_broadcast(gone.count(), 48)
    rows = docs.withColumns(dict(zip(names, identity(text, doc_id), strict=True)))
    left = rows.join(F.broadcast(gone) if small else gone, names, "left_anti")
    again = classed.where(first & (F.col("copies") > 1)).groupBy(*keys).count().where("count > 1").drop("count")
    if not again.isEmpty():
        left = left.join(again, names, "left_anti").unionByName(left.join(again, names, "left_semi").dropDuplicates(names))
    return left.select(*[named(c) for c in docs.columns])
