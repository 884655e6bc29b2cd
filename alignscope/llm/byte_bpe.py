"""Byte-level BPE, encoded in linear time from longest matches, and decoded.

A piece of text is mapped byte by byte to Latin-1 characters. An Aho-Corasick automaton of the vocabulary finds the
longest token at every position. The encoder takes longest matches from left to right and backtracks to shorter
prefixes; a token may follow another only if merging by rank would keep the two apart, a test that is memoised for
pairs of tokens and undoes merges from both sides of the border. An end position from which no way led on is never
entered again, so the work is linear in the piece. Pieces and space-separated chunks are remembered.

Which code points are letters, numbers and white space is asked of the encoding library itself, as its Unicode tables are
not those of the module that splits texts here: code points of which the two think differently are split as if they were
a stand-in of the library's class.

Defined cases: a null text is an empty one; an empty text has no ids; texts of any length are encoded whole; each row is
encoded by itself, so ties and repeated rows need no rule; an empty table gives no rows; other columns, whatever they
are called, are ignored. Any pattern of these classes may be passed; for others than ``CHUNKED`` texts are matched whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import Pieces, bounds, filled, slices
from .common import named

#: Chunks, pieces and pairs of tokens that a Python worker remembers at most, and the longest remembered piece.
CACHE, LONGEST = 1 << 19, 256
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Fixed value: the usual pattern, no match of which goes on before a single space between two other characters.
CHUNKED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stand-ins of the classes, and of all other characters.
STAND_INS = {r"\p{L}": "ß", r"\p{N}": "0", r"\s": "\t"}
STAND_IN_OTHER = "!"


@lru_cache(maxsize=1)
def stand_ins() -> dict[int, str]:
    """Code points whose class differs between the encoding library and the splitting module -> a stand-in of the library's."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    theirs: dict[str, str] = {}
    differ: set[str] = set()
    for name, stand_in in STAND_INS.items():
        # only what the pattern matches is encoded, here byte by byte
        library = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=single, special_tokens={})
        members = set(bytes(library.encode_ordinary(every)).decode())
        theirs |= dict.fromkeys(members, stand_in)
        differ |= members ^ set("".join(regex.findall(f"{name}+", every)))
    return {ord(c): theirs.get(c, STAND_IN_OTHER) for c in differ}


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.dtype = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"
        self.find, self.chunked = regex.compile(pattern), pattern == CHUNKED
        self.foreign = stand_ins()
        self.strange = frozenset(map(chr, self.foreign))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.table = Pieces(self.tokens, "u1")

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, or None for a token that no merge makes."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], token)) < token]
                if not ranked:
                    break
                _, i = min(ranked)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def prefix(self, token: int) -> int | None:
        """The longest token that is a shorter beginning of this one."""
        if token not in self.shorter:
            whole = self.tokens[token]
            self.shorter[token] = next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), None)
        return self.shorter[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between these two neighbours."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # The merges next to the border are undone from the latest on. A merge across the border that is due earlier
        # than the merge undone last would have come before it.
        due = len(self.tokens)
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < due:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                due, left = left, a[1]
            else:
                # of equal tokens the left one is merged first, so the right one's merge yields to a tie
                due, right = right + 1, b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, sizes = len(piece), self.tokens
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end - len(sizes[token]) + 1] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(sizes[token])
                if open_[end] and (last is None or self.apart(last, token)):
                    break
                token = self.prefix(token)
            if token is not None:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(sizes[token])

    def encode_text(self, text: str) -> bytes:
        """Ids of any text, each match of the pattern separately."""
        known, out = self.pieces, []
        if text.isascii() or self.strange.isdisjoint(text):
            pieces = self.find.findall(text)
        else:
            pieces = [text[m.start() : m.end()] for m in self.find.finditer(text.translate(self.foreign))]
        for piece in pieces:
            got = known.get(piece)
            if got is None:
                got = np.array(self.encode_piece(piece.encode()), self.dtype).tobytes()
                if len(piece) <= LONGEST:
                    known[piece] = got
            out.append(got)
        return b"".join(out)

    def _trim(self) -> None:
        for cache in (self.chunks, self.pieces, self.pairs):
            if len(cache) > CACHE:
                cache.clear()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and where each text's begin.

        A match never goes on before a single space between two other characters, so a text whose spaces are all of
        that kind is the concatenation of its chunks, each with the space before it. Other texts are matched whole.
        """
        self._trim()
        lists = pc.split_pattern(texts, " ")
        coded, offsets = lists.flatten().dictionary_encode(), np.asarray(lists.offsets)
        offsets = offsets - offsets[0]
        numbers = coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary.to_pylist()
        odd = np.fromiter((not x or x[0].isspace() or x[-1].isspace() for x in names), bool, len(names))
        odd |= not self.chunked
        whole = np.flatnonzero(np.logical_or.reduceat(odd[numbers], offsets[:-1])) if len(numbers) else np.array([], np.int64)
        runs: list[bytes] = []
        known = self.chunks
        for name, bad in zip(names, odd, strict=True):
            run = b"" if bad else known.get(name)
            if run is None:
                run = self.encode_text(" " + name)
                if len(name) <= LONGEST:
                    known[name] = run
            runs.append(run)
        # the first chunk of a text has no space before it; a text that is matched whole is one chunk
        firsts = offsets[:-1]
        heads = [names[i] for i in numbers[firsts]]
        keep = np.ones(len(numbers), bool)
        alone = set(whole.tolist())
        for k in whole:
            keep[firsts[k] + 1 : offsets[k + 1]] = False
        extra = [self.encode_text(texts[k].as_py() if k in alone else heads[k]) for k in range(len(heads))]
        numbers[firsts] = len(runs) + np.arange(len(heads))
        table = Pieces(runs + extra, self.dtype)
        lens = np.where(keep, table.lens[numbers], 0)
        return table.expand(numbers[keep], lens[keep]), bounds(lens, offsets)

    def decode(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """The bytes of ids, in blocks."""
        for i in range(0, len(ids), 1 << 20):
            part = ids[i : i + (1 << 20)]
            yield self.table.expand(part, self.table.lens[part])


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per Python worker, kept from task to task."""
    key = (path, pattern)
    if key not in _CODERS:
        _CODERS[key] = ByteBpe(path, pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ids array<int> of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = filled(batch.column(1))
            for a, b in slices(texts):
                ids, begins = bpe.encode(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode every document, decode its ids again, and return digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            texts = filled(batch.column(1))
            for a, b in slices(texts):
                ids, begins = bpe.encode(texts.slice(a, b - a))
                counts, coded, decoded = [], [], []
                for k in range(b - a):
                    own = ids[begins[k] : begins[k + 1]]
                    back = hashlib.sha256()
                    for part in bpe.decode(own):
                        back.update(part)
                    counts.append(len(own))
                    coded.append(hashlib.sha256(own.astype("<u4")).hexdigest())
                    decoded.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)
