"""Cost-balanced packing of token documents into sequences.

A document costs ``LINEAR * n + QUADRATIC * n * n`` for its n tokens, as attention does. In each window of tokens the
documents are dealt, longest first, to the sequence of the lowest cost so far that still has room for them. What fits
nowhere is cut to fill the sequences up, so none has padding; what is left over goes on to the next window, and at the
end of a partition into sequences whose lengths are powers of two, which aren't padded either. A window is bounded, so
memory is too; there is no shuffle, and a task that is repeated makes the same sequences.

Defined cases: a null text is an empty one and has only the end id; a special token's string in a text is that token, as
in a plain call of the library; each row is a document of its own, also with a doc_id that repeats or is null; of
documents of one length the first comes first; a document longer than a sequence is cut, its full pieces being sequences
of their own; an empty table has no pieces; other columns, whatever they are called, are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import Pieces, bounds, filled, give_back, slices
from .common import named

SEQUENCE, END_ID = 4096, 2
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE
#: Tokens that are packed at once.
WINDOW = 1 << 21
#: Chunks and, apart from them, words that a Python worker remembers at most, and bytes of the longest remembered one.
CACHE, LONGEST = 1 << 17, 256
#: Bytes of text that are encoded at once (a longer text goes alone), and strings that are encoded together.
AT_ONCE, TOGETHER = 1 << 20, 1 << 15

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SAFE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")


#: The settings of a tokenizer file that the shortcuts below are made for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}


def known_settings(path: str) -> list[str]:
    """The strings of the file's added tokens; an error if its settings aren't those that this module knows."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split, level = steps[0], steps[-1]
    added = d.get("added_tokens") or []
    fits = (
        d.get("normalizer") == NORMALIZER
        and len(steps) == 2
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and all(d["model"].get(k) == v for k, v in MODEL.items())
        and max([*d["model"]["vocab"].values(), *(t["id"] for t in added)]) < 1 << 16
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added)
    )
    if not fits:
        raise ValueError(f"{path}: a tokenizer with other settings than this packing knows")
    return [t["content"] for t in added]


class Known:
    """Runs of ids of strings that were met before, in flat arrays: about a fifth of the memory of a dict.

    When there are too many, those of the last call stay, which hold the frequent ones.
    """

    def __init__(self) -> None:
        self.names, self.runs = pa.array([], pa.large_string()), Pieces([], "<u2")

    def runs_of(self, names: pa.Array, make: Callable[[list[str]], Pieces]) -> Pieces:
        """A run for each of these different strings; ``make`` encodes those that aren't known."""
        at = pc.index_in(names, value_set=self.names)
        fresh = pc.is_null(at)
        new = names.filter(fresh)
        made = [make(new.slice(k, TOGETHER).to_pylist()) for k in range(0, len(new), TOGETHER)]
        every = Pieces.joined([self.runs, *made])
        where = np.array(pc.fill_null(at, 0))
        where[np.asarray(fresh)] = len(self.names) + np.arange(len(new))
        out = every.take(where)
        if len(self.names) + len(new) > CACHE:
            self.names, self.runs = names, out
        else:
            self.names, self.runs = pa.concat_arrays([self.names, new]), every
        short = pc.less_equal(pc.binary_length(self.names), LONGEST)
        if len(self.names) > CACHE or not pc.all(short).as_py():
            stay = np.flatnonzero(short)[:CACHE]
            self.names, self.runs = self.names.take(pa.array(stay)), self.runs.take(stay)
        return out


class WordTokenizer:
    """The tokenizer's ids, from a cache of white-space separated chunks.

    The tokenizer drops white space, and neither a match of its pattern nor an added token spans any, so chunks can be
    encoded one by one. Chunks of ASCII and Latin-1 letters, whose normal form and lower case are plain, are split here
    and reach the BPE model word by word; any other chunk, and any with an added token, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.added = known_settings(path)
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.letters = [table[b] for b in range(256)]
        self.chunks, self.words = Known(), Known()

    def _words(self, words: list[str]) -> Pieces:
        shown = (w if w.isascii() else "".join([self.letters[b] for b in w.encode()]) for w in words)
        return Pieces([array("H", [t.id for t in self.model.tokenize(w)]).tobytes() for w in shown], "<u2")

    def _chunks(self, chunks: list[str]) -> Pieces:
        parts: list[str] = []
        counts, odd, odd_runs = np.zeros(len(chunks) + 1, np.int64), [], []
        for k, chunk in enumerate(chunks):
            if not _SAFE.fullmatch(chunk) or any(t in chunk for t in self.added):
                odd.append(k)
                odd_runs.append(np.array(self.full.encode(chunk, add_special_tokens=False).ids if chunk else [], "<u2").tobytes())
            else:
                own = _PARTS.findall(chunk.lower())
                parts += own
                counts[k + 1] = len(own)
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        words, numbers = self.words.runs_of(coded.dictionary, self._words), coded.indices.to_numpy()
        lens = words.lens[numbers]
        plain = Pieces.of(words.expand(numbers, lens), np.diff(bounds(lens, np.cumsum(counts))))
        if not odd:
            return plain
        order = np.arange(len(chunks))
        order[odd] = len(chunks) + np.arange(len(odd))
        return Pieces.joined([plain, Pieces(odd_runs, "<u2")]).take(order)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and where each text's begin."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        pieces, numbers = self.chunks.runs_of(coded.dictionary, self._chunks), coded.indices.to_numpy()
        offsets = np.asarray(lists.offsets)
        lens = pieces.lens[numbers]
        return pieces.expand(numbers, lens), bounds(lens, offsets - offsets[0])


class Piece:
    """Tokens of one document that are still together."""

    __slots__ = ("ids", "row", "start", "total")

    def __init__(self, row: object, start: int, total: int, ids: np.ndarray) -> None:
        self.row, self.start, self.total, self.ids = row, start, total, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.total, self.ids[:n]), Piece(self.row, self.start + n, self.total, self.ids[n:])


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(pieces: list[Piece], last: bool, size: int = SEQUENCE) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, and the pieces left over (fewer than ``size`` tokens; none if ``last``)."""
    full: list[list[Piece]] = []
    short: list[Piece] = []
    for p in pieces:
        while len(p.ids) >= size:
            head, p = p.cut(size)
            full.append([head])
        if len(p.ids):
            short.append(p)
    short.sort(key=lambda p: -len(p.ids))
    n = sum(len(p.ids) for p in short) // size
    bins: list[list[Piece]] = [[] for _ in range(n)]
    room, costs, rest = np.full(n, size), np.zeros(n), []
    for p in short:
        k, best = len(p.ids), -1
        if n:
            best = int(np.argmin(np.where(room >= k, costs, np.inf)))
        if n and room[best] >= k:
            bins[best].append(p)
            room[best] -= k
            costs[best] += cost(k)
        else:
            rest.append(p)
    rest.reverse()
    for b in np.argsort(costs, kind="stable"):
        rest = _fill(bins[b], rest, int(room[b]))
    left = rest[::-1]
    full += bins
    if last:
        total = sum(len(p.ids) for p in left)
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                full.append(some := [])
                left = _fill(some, left[::-1], 1 << bit)[::-1]
    return full, left


def _fill(bin_: list[Piece], stack: list[Piece], room: int) -> list[Piece]:
    """Move pieces from the end of ``stack`` into a sequence until it has no room; the last one is cut."""
    while room:
        p = stack.pop()
        if len(p.ids) > room:
            p, tail = p.cut(room)
            stack.append(tail)
        bin_.append(p)
        room -= len(p.ids)
    return stack


def _rows(sequences: list[list[Piece]], first: int) -> pa.RecordBatch:
    out: list[tuple] = []
    for s, bin_ in enumerate(sequences):
        at = 0
        for p in bin_:
            out.append((p.row, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, first + s, at))
            at += len(p.ids)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", size: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        coder = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordTokenizer(tokenizer))
        waiting: list[Piece] = []
        tokens = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), filled(batch.column(1))
            for a, b in slices(texts, AT_ONCE):
                ids, begins = coder.encode(texts.slice(a, b - a))
                for k in range(b - a):
                    own = np.append(ids[begins[k] : begins[k + 1]], np.uint16(END_ID))
                    waiting.append(Piece(names[a + k], 0, len(own), own))
                    tokens += len(own)
                if tokens >= window:
                    sequences, waiting = pack(waiting, False, size)
                    tokens = sum(len(p.ids) for p in waiting)
                    yield _rows(sequences, made)
                    made += len(sequences)
        sequences, _ = pack(waiting, True, size)
        yield _rows(sequences, made)
        del sequences, waiting
        give_back()

    return docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
