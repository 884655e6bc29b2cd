"""Language identification by bit-sliced Bloom filters of character n-grams.

Every slot of one shared filter holds a bit mask of languages: the slices of all languages' Bloom filters side by side.
The conjunction of an n-gram's slots is the set of all languages that contain the n-gram. A text's n-grams are counted
for each language; counts are corrected for the false positives that each slice's fill makes likely, and for the share
of a language's own n-grams that its filter knows. The highest corrected count decides.

Training takes about ``SAMPLE`` different texts of each language (those with the lowest hashes), a bounded sample that
neither ids nor copies sway; every document is then classified by its whole text. N-grams that make up less than
``MIN_SHARE`` of a language's sample are not learned, so a language has at most 1/MIN_SHARE of them, and a language with
few rows learns all of its own. The model has 64 languages to a plane of at most 8 MB, and no bound on languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text none of whose n-grams is known gets
the language with the most training rows (of equals the one that sorts first) and score 0; ties go to the language that
sorts first; without training rows all is ``und``; rows whose language is null are no training rows but are classified;
each row is classified by itself, so repeated rows need no rule; texts of any length are read whole; an empty table gives
no rows; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import filled, slices
from .common import fits_broadcast, named

SAMPLE, MIN_SHARE = 4000, 1e-5
#: Letters of an n-gram, most slots of the filter, slots for each n-gram of the largest language, and hashes.
N, SLOTS, SLOTS_PER_GRAM, HASHES = 4, 1 << 20, 16, 3
UND = "und"
SCHEMA = "doc_id long, lang_pred string, score double"

_LETTER = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)
#: Odd multipliers for hashing.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams with a letter, the number of the text of each, and which texts have letters.

    Letters are lower-cased, each run of other characters counts as one space, and each text stands between spaces.
    """
    joined = "".join([f"\n  {t.lower()}  " for t in texts]) if not any("\n" in t for t in texts) else "".join(["\n  " + t.lower().replace("\n", " ") + "  " for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = codes == 10
    low = codes < (1 << 16)
    letter = _LETTER[np.where(low, codes, 0)]
    if not low.all():
        high = np.flatnonzero(~low)
        letter[high] = [chr(c).isalpha() for c in codes[high]]
    text_of = np.cumsum(mark) - 1
    keep = letter | mark
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    after = np.zeros(len(keep), bool)
    after[1:] = mark[:-1]
    keep |= after
    kept = np.where(letter, codes, 32).astype(np.uint64)[keep]
    of, is_letter, is_mark = text_of[keep], letter[keep], mark[keep]
    has = np.zeros(len(texts), bool)
    has[of[is_letter]] = True
    m = len(kept) - N + 1
    if m <= 0:
        return np.array([], np.uint64), np.array([], np.int64), has
    h = np.zeros(m, np.uint64)
    some = np.zeros(m, bool)
    broken = np.zeros(m, bool)
    for i in range(N):
        h = (h ^ kept[i : i + m]) * _ODD[i]
        h ^= h >> np.uint64(29)
        some |= is_letter[i : i + m]
        broken |= is_mark[i : i + m]
    good = some & ~broken
    return h[good], of[:m][good], has


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """Slots of n-grams in a filter of ``size`` slots, a power of two."""
    h = h * _ODD[0]
    h ^= h >> np.uint64(32)
    return [((h >> np.uint64(20 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


class Model:
    """The bit-sliced filter and what corrects its counts."""

    def __init__(self, languages: list[str], known: list[np.ndarray], coverage: list[float], usual: int) -> None:
        self.languages, self.usual = languages, usual
        self.coverage = np.array(coverage)
        most = max([len(h) for h in known], default=0) * SLOTS_PER_GRAM
        self.size = min(SLOTS, 1 << max(most - 1, 1 << 12).bit_length())
        self.planes = [np.zeros(self.size, np.uint64) for _ in range(0, len(languages), 64)]
        for i, h in enumerate(known):
            for s in slots(h, self.size):
                self.planes[i // 64][s] |= np.uint64(1 << (i % 64))
        fill = np.array([np.count_nonzero(self.planes[i // 64] & np.uint64(1 << (i % 64))) / self.size for i in range(len(languages))])
        self.chance = fill**HASHES

    def counts(self, h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """For each text and language, how many of the text's n-grams the language's filter holds."""
        out = np.zeros((n, len(self.languages)))
        at = slots(h, self.size)
        for p, plane in enumerate(self.planes):
            mask = plane[at[0]]
            for s in at[1:]:
                mask &= plane[s]
            for i in range(p * 64, min(len(self.languages), p * 64 + 64)):
                out[:, i] = np.bincount(of, (mask >> np.uint64(i % 64)) & np.uint64(1), n)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        h, of, has = grams(texts)
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        total = np.bincount(of, minlength=len(texts))[:, None]
        hits = np.maximum((self.counts(h, of, len(texts)) - total * self.chance) / (1 - self.chance), 0) / self.coverage
        best, whole = hits.argmax(1), hits.sum(1)
        best[whole == 0] = self.usual
        score = np.where(whole > 0, hits.max(1) / np.where(whole > 0, whole, 1), 0.0)
        names = [self.languages[b] if ok else UND for b, ok in zip(best, has, strict=True)]
        return names, np.where(has, np.clip(score, 0, 1), 0.0)


def train(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from a bounded sample of each language; what reaches the driver is bounded by languages and MIN_SHARE."""
    tongue, body = named(lang).cast("string"), named(text).cast("string")
    labelled = rows.where(tongue.isNotNull()).select(tongue.alias("lang"), F.coalesce(body, F.lit("")).alias("text"))
    per = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in per.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [], [], 0)
    # hashes are uniform, so a bound on them draws about ``sample`` texts of a language where they stand; copies go
    share = per.sparkSession.createDataFrame([(n, int(min(1.0, sample / sizes[n]) * 2**62)) for n in languages], "lang string, below long")
    met = labelled.join(F.broadcast(share) if fits_broadcast(len(languages), 128) else share, "lang")
    drawn = met.where(F.xxhash64("text", F.lit(7)).bitwiseAND(F.lit(2**62 - 1)) < F.col("below")).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = np.array(batch.column(0).to_pylist()), filled(batch.column(1))
            for a, b in slices(texts):
                h, of, _ = grams(texts.slice(a, b - a).to_pylist())
                for n in np.unique(names[a:b]):
                    g, c = np.unique(h[(names[a:b] == n)[of]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c, pa.int64())], ["lang", "g", "c"])

    counted = drawn.mapInArrow(count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    totals = counted.groupBy("lang").agg(F.sum("c").alias("total"))
    totals = F.broadcast(totals) if fits_broadcast(len(languages), 128) else totals
    kept = counted.join(totals, "lang").where(F.col("c") >= F.col("total") * MIN_SHARE).toPandas()
    own = dict(tuple(kept.groupby("lang")))
    none = kept.iloc[:0]
    known = [own.get(n, none)["g"].to_numpy(np.int64).view(np.uint64) for n in languages]
    # of a language's n-grams in the sample, the share that is learned
    coverage = [float(own[n]["c"].sum()) / float(own[n]["total"].iloc[0]) if n in own else 1.0 for n in languages]
    return Model(languages, known, coverage, max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)))


def classify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score for every row; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = filled(batch.column(1))
            for a, b in slices(texts, 1 << 20):
                names, score = m.predict(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(named(doc_id).cast("string")) % 4 == 2
