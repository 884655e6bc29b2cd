"""A quality classifier that is trained on weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. How often each pattern of votes occurs is
counted over all documents; expectation-maximisation on these counts (at most 3 to the number of labellers, whatever the
corpus) estimates each labeller's accuracy on good and on bad documents and the share of good ones, as if votes were
independent given the class. The posterior of a document's pattern is its label. A linear scorer on hashed n-grams of
character classes and of characters, and on echoes of the last four words, is then trained on a bounded sample of
different texts (about ``SAMPLE``, those with the lowest hashes, and never over ``SAMPLE_BOUND``; neither ids nor copies
sway it) with these labels, and every document is scored by its whole text.

Defined cases: a null text is an empty one; an empty text has no n-grams, and its score is the labellers' posterior of
an empty text's votes; labellers say nothing of texts with under ``FEW_WORDS`` words, as shares of so few mean little,
and the scorer alone decides on them; documents are scored one by one, so ties and repeated rows need no rule, and texts
of any length are read whole; with an empty table nothing is trained and nothing returned; other columns, whatever they
are called, are carried through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import filled, give_back, slices
from .common import named

SAMPLE, SAMPLE_BOUND, ROUNDS, EPOCHS = 4000, 5000, 200, 120
#: Sizes of the feature spaces: hashed n-grams of character classes and of characters, and which of the last words a word repeats.
SHAPES, GRAMS, ECHOES = 1 << 13, 1 << 14, 1 << 4
KEEP, FEW_WORDS = 0.2, 8

#: Character classes: other letter, upper, digit, space, line end, full stop or comma, other sentence mark, symbol, bar, other.
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL, BAR, OTHER = range(10)


def _classes() -> np.ndarray:
    out = np.full(1 << 16, OTHER, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            out[i] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            out[i] = DIGIT
        elif c == "\n":
            out[i] = LINE
        elif c.isspace():
            out[i] = SPACE
    for chars, kind in ((".,", STOP), ("!?;:'\"()-", MARK), ("#*$%&<>@^~=+_{}[]\\/", SYMBOL), ("|", BAR)):
        out[[ord(c) for c in chars]] = kind
    return out


_CLASS = _classes()

#: What is believed of any labeller before counting, as strong as this share of the corpus: how often it votes nothing,
#: good and bad on bad and on good documents. Without it a kind of bad document that few labellers see joins the good ones.
BELIEF = np.array([[0.05, 0.7, 0.25], [0.05, 0.94, 0.01]])
BELIEF_SHARE = 0.5

#: Bytes of text that are worked on at once (a longer text goes alone).
AT_ONCE = 1 << 18

#: The labellers: name, value (a column of ``profile``), good when at most, bad when at least; in between no vote.
LABELLERS = (
    ("symbols a word", 0, 0.1, 0.4),
    ("upper case among letters", 1, 0.15, 0.4),
    ("exclamation and question marks a word", 2, 0.05, 0.3),
    ("bars a word", 3, 0.02, 0.2),
    ("odd share of words over three letters", 4, 0.15, 0.3),
    ("marks other than stops among marks", 5, 0.3, 0.7),
    ("odd mean length of words", 6, 3.0, 6.0),
    ("words that repeat one of the last four", 7, 0.15, 0.5),
    ("words that came before", 8, 0.5, 0.8),
    ("pairs of words that came before", 9, 0.3, 0.6),
)


def decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with a line end before each, their classes, and the number of the text of each code."""
    joined = "".join([f"\n{t}" for t in texts])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < (1 << 16), _CLASS[codes & 0xFFFF], LOWER)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, kinds, np.repeat(np.arange(len(texts)), sizes)


def echoes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word a bit for each of the last four words of its text that it equals; and the number of its text."""
    words = [t.split() for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = np.fromiter((hash(w) for ws in words for w in ws), np.int64, len(of))
    out = np.zeros(len(h), np.int64)
    for back in range(1, 5):
        if len(h) > back:
            out[back:] |= ((h[back:] == h[:-back]) & (of[back:] == of[:-back])).astype(np.int64) << (back - 1)
    return out, of


def seen_before(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the shares of words and of pairs of words that came before in it."""
    words, pairs = np.zeros(len(texts)), np.zeros(len(texts))
    for k, t in enumerate(texts):
        w = t.split()
        if len(w) > 1:
            words[k] = 1 - len(set(w)) / len(w)
            pairs[k] = 1 - len(set(zip(w, w[1:], strict=False))) / (len(w) - 1)
    return words, pairs


def profile(texts: list[str], codes: np.ndarray, kinds: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One row per text: what the labellers look at."""
    n = len(texts)
    tally = lambda where: np.bincount(of[where], minlength=n).astype(float)
    blank = (kinds == SPACE) | (kinds == LINE)
    begins = ~blank
    begins[1:] &= blank[:-1]
    words = np.maximum(tally(begins), 1)
    letters = (kinds == LOWER) | (kinds == UPPER)
    # words of letters: where runs of letters begin, and how long they are
    edge = letters.copy()
    edge[1:] &= ~letters[:-1]
    first = np.flatnonzero(edge)
    stop = letters.copy()
    stop[:-1] &= ~letters[1:]
    length = np.flatnonzero(stop) - first + 1 if len(first) else np.array([], np.int64)
    runs = np.maximum(np.bincount(of[first], minlength=n), 1)
    long = np.bincount(of[first], length > 3, n)
    mean = np.bincount(of[first], length, n) / runs
    loud = (codes == 33) | (codes == 63)
    marks = (kinds == MARK) | (kinds == SYMBOL) | (kinds == BAR)
    stops = tally(kinds == STOP)
    echo, word_of = echoes(texts)
    repeated = np.bincount(word_of, echo > 0, n) / np.maximum(np.bincount(word_of, minlength=n), 1)
    return np.stack(
        [
            tally(kinds == SYMBOL) / words,
            tally(kinds == UPPER) / np.maximum(tally(letters), 1),
            tally(loud) / words,
            tally(kinds == BAR) / words,
            np.abs(long / runs - 0.65),
            tally(marks) / np.maximum(tally(marks) + stops, 1),
            np.abs(mean - 5),
            repeated,
            *seen_before(texts),
            words,
        ],
        1,
    )


def vote(values: np.ndarray) -> np.ndarray:
    """A number per text that stands for its pattern of votes: one digit of base 3 per labeller (0 none, 1 good, 2 bad)."""
    out = np.zeros(len(values), np.int64)
    enough = values[:, -1] >= FEW_WORDS
    for _, column, good, bad in LABELLERS:
        v = values[:, column]
        out = out * 3 + np.where(enough, np.where(v <= good, 1, np.where(v >= bad, 2, 0)), 0)
    return out


def digits(pattern: np.ndarray) -> np.ndarray:
    k = len(LABELLERS)
    return pattern[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, vote probabilities [class, labeller, vote] and the share of good documents."""
    votes = digits(patterns)
    silent = (votes == 0).all(1)  # says nothing about labellers; it gets the share of good documents
    counts = np.where(silent, 0.0, counts)
    # start: one vote for bad outweighs the usual number of votes for good, as most ways to be bad concern one labeller
    good, bad = (votes == 1).sum(1), (votes == 2).sum(1)
    post = (good + 1) / (good + 10 * bad + 2)
    theta, prior = np.zeros((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        for v in range(3):
            theta[:, :, v] = weight @ (votes == v) + (1.0 + BELIEF_SHARE * counts.sum()) * BELIEF[:, v, None]
        theta /= theta.sum(2, keepdims=True)
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        logs = np.log(theta)
        like = np.stack([sum(logs[c, j, votes[:, j]] for j in range(votes.shape[1])) for c in (0, 1)])
        odds = like[1] - like[0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return np.where(silent, prior, post), theta, float(prior)


def features(codes: np.ndarray, kinds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the hashed n-grams at every place, shapes then characters, and the number of the text of each place."""
    m = len(codes) - 4
    if m <= 0:
        none = np.array([], np.int64)
        return none, none, none
    inside = of[:m] == of[4:]
    shape = np.zeros(m, np.uint32)
    for i in range(5):
        shape = shape * np.uint32(10) + kinds[i : i + m]
    shape = (shape * np.uint32(2654435761)) >> np.uint32(32 - 13)
    gram = np.zeros(m, np.uint32)
    for i in range(3):
        gram = (gram ^ codes[i : i + m]) * np.uint32(2246822519)
        gram ^= gram >> np.uint32(15)
    gram = (gram >> np.uint32(8)) & np.uint32(GRAMS - 1)
    return shape[inside].astype(np.int64), gram[inside].astype(np.int64) + SHAPES, of[:m][inside]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of feature shares, by Adam on the whole sample."""
    n = len(rows)
    of = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    index = np.concatenate([i for i, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows]).astype(float)
    w, b = np.zeros(SHAPES + GRAMS + ECHOES), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    # both classes weigh as much, so that rare bad documents are learned
    share = min(max(labels.mean(), 0.02), 0.98)
    weight = np.where(labels >= 0.5, 0.5 / share, 0.5 / (1 - share))
    weight /= weight.sum()
    for t in range(1, epochs + 1):
        z = np.bincount(of, w[index] * value, n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        g = np.bincount(index, err[of] * value, len(w)) + 1e-6 * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.3 / np.sqrt(1 + t / 50)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-10)
    return w, float(b)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, empty: float) -> None:
        self.weights, self.bias, self.empty = weights.astype(np.float32), bias, empty

    def score(self, texts: list[str]) -> np.ndarray:
        n = len(texts)
        shape, gram, of = features(*decode(texts))
        total = np.bincount(of, minlength=n)
        echo, word_of = echoes(texts)
        said = np.bincount(word_of, self.weights[echo + SHAPES + GRAMS], n) / np.maximum(np.bincount(word_of, minlength=n), 1)
        z = said + (np.bincount(of, self.weights[shape], n) + np.bincount(of, self.weights[gram], n)) / np.maximum(total, 1) + self.bias
        return np.where(total > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.empty)


def _mapped(docs: DataFrame, columns: list, work, schema: str, at: int = -1) -> DataFrame:
    """Apply ``work(rest of the batch, texts)`` to slices of the texts, which are the last column or number ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(at % batch.num_columns))
            for a, b in slices(texts, AT_ONCE):
                yield work(batch.slice(a, b - a), texts.slice(a, b - a).to_pylist())
        give_back()

    return docs.select(*columns).mapInArrow(run, schema)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, bound: int = SAMPLE_BOUND) -> Model | None:
    def votes(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        p, c = np.unique(vote(profile(texts, *decode(texts))), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(c)], ["pattern", "n"])

    body = F.coalesce(named(text).cast("string"), F.lit("")).alias("text")
    # at most 3 ** len(LABELLERS) rows reach the driver; in order, as sums of floats depend on it
    table = _mapped(docs, [body], votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    if not len(table):
        return None
    patterns, counts = table["pattern"].to_numpy(np.int64), table["n"].to_numpy(float)
    post, _, prior = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), post.tolist(), strict=True))

    def counted(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        codes, kinds, of = decode(texts)
        p = vote(profile(texts, codes, kinds, of))
        shape, gram, at = features(codes, kinds, of)
        echo, word_of = echoes(texts)
        index, value = [], []
        for k in range(len(texts)):
            a, b = np.searchsorted(at, [k, k + 1])
            i, c = np.unique(np.concatenate([shape[a:b], gram[a:b]]), return_counts=True)
            d, e = np.searchsorted(word_of, [k, k + 1])
            j, f = np.unique(echo[d:e], return_counts=True)
            index.append(np.concatenate([i, j + SHAPES + GRAMS]).astype(np.int32).tobytes())
            value.append(np.concatenate([c / max(b - a, 1), f / max(e - d, 1)]).astype(np.float32).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["h", "pattern", "i", "v"])

    share = min(1.0, sample / counts.sum())
    drawn = docs.select(body).select(F.xxhash64("text", F.lit(11)).bitwiseAND(F.lit(2**62 - 1)).alias("h"), "text").where(F.col("h") < int(share * 2**62)).distinct()
    got = _mapped(drawn, ["h", "text"], counted, "h long, pattern long, i binary, v binary").orderBy("h", "i").limit(bound).collect()
    labels = np.array([posterior[r["pattern"]] for r in got])
    empty = posterior.get(int(vote(profile([""], *decode([""])))[0]), prior)
    if not len(labels):
        return Model(np.zeros(SHAPES + GRAMS + ECHOES), float(np.log(prior / (1 - prior))), empty)
    return Model(*fit([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32)) for r in got], labels), empty)


def score(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (probability of a good document), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        s = shared.value.score(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= KEEP)], ["doc_id", "score", "kept"])

    return _mapped(docs, [named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")], scored, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, where they stand."""
    model = train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # plain names inside, as Arrow maps don't take every name; texts that are a column already aren't sent twice
    columns = [named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    inside = docs.select(*columns)
    there = (text, "string") in docs.dtypes

    def kept(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        own = batch if there else pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
        return own.filter(pa.array(shared.value.score(texts) >= KEEP))

    more = [] if there else [named(text).cast("string").alias("text")]
    return _mapped(docs, [*columns, *more], kept, inside.schema, docs.columns.index(text) if there else -1).toDF(*docs.columns)
