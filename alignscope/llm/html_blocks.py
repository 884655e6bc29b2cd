"""HTML pages as sequences of text blocks, with what the block labeller reads of each."""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np

#: Elements that are never text, elements that don't break a block, elements without an end tag.
SKIPPED = frozenset("head title script style noscript template iframe object svg canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
#: What can stand in a head; the start of anything else, or text, closes an open head.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|title"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?P<inside>.*?)(?:</(?P=raw)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")

PATH, WORDS, NUMBERS = 64, 24, 9
#: Words from which on a block's words count as shares.
USUAL = 24
WIDTH = PATH + WORDS + NUMBERS


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


def blocks(html: str) -> list[Block]:
    """Every leaf text of a page in order, with the names on its path (tags, and words of class, id and role)."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = skipped = links = 0
    where: tuple[str, ...] = ()
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}  # equal paths are kept once

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append(Block(joined, where, linked))
            text.clear()
        linked = 0

    def close_head() -> None:
        k = next((k for k, (t, _) in enumerate(stack) if t == "head"), len(stack))
        for t, _ in stack[k:]:
            leave(t)
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal linked, where
        if skipped and stack[-1][0] == "head" and not raw.isspace() and raw:
            close_head()
        if raw and not skipped:
            plain = unescape(raw)
            if not text:
                where = tuple(n for _, names in stack for n in names)
                where = paths.setdefault(where, where)
            text.append(plain)
            if links:
                linked += len(plain)

    def leave(tag: str) -> None:
        nonlocal skipped, links
        skipped -= tag in SKIPPED
        links -= tag == "a"

    at = 0
    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() == "textarea":
                flush()
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while True:
                    t, _ = stack.pop()
                    leave(t)
                    if t == tag:
                        break
                    if t not in INLINE:
                        flush()
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    for t, _ in stack[k:]:
                        leave(t)
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag not in IN_HEAD:
            close_head()
        if tag in VOID:
            continue
        named = [tag]
        if m["attrs"]:
            for parts in _NAMED.findall(m["attrs"]):
                named += _PARTS.findall("".join(parts).lower())
        stack.append((tag, tuple(named)))
        skipped += tag in SKIPPED
        links += tag == "a"
    say(html[at:])
    flush()
    return out


_NAMES: dict[str, int] = {}
_SAID: dict[str, int] = {}


def _slot(word: str, size: int, known: dict[str, int]) -> int:
    """The slot of a name or word; ``known`` remembers a bounded number of short ones."""
    got = known.get(word)
    if got is None:
        got = zlib.crc32(word.encode("utf-8", "replace")) % size
        if len(known) > 1 << 18:
            known.clear()
        if len(word) <= 64:
            known[word] = got
    return got


def vectors(page: list[Block], first: int = 0, end: int | None = None) -> np.ndarray:
    """One row per block from ``first`` to ``end``: hashed names of its path (the inner half counts twice), all its words
    hashed (counts; of over ``USUAL`` words shares, as if there were so many), and numbers."""
    some = page[first:end]
    out = np.zeros((len(some), WIDTH), np.float32)
    paths: dict[tuple[str, ...], np.ndarray] = {}
    numbers = []
    for k, b in enumerate(some):
        row = paths.get(b.path)
        if row is None:
            row = np.zeros(PATH, np.float32)
            for i, name in enumerate(b.path):
                row[_slot(name, PATH, _NAMES)] = 1.0
                if i >= len(b.path) - 2:
                    row[_slot("^" + name, PATH, _NAMES)] += 1.0
            if len(paths) > 1 << 12:
                paths.clear()
            paths[b.path] = row
        out[k, :PATH] = row
        words = b.text.lower().split(" ")
        n, chars = len(words), len(b.text)
        cells = [_SAID[w] if w in _SAID else _slot(w, WORDS, _SAID) for w in words]
        out[k, PATH : PATH + WORDS] = 0.3 * min(1.0, USUAL / n) * np.bincount(cells, minlength=WORDS)
        stops = b.text.count(".") + b.text.count(",")
        numbers.append((n, chars, b.linked / chars, min(stops / n, 1.0), chars / n / 10, (first + k) / len(page), n < 4, b.text[-1] in ".!?", 1.0))
    if some:
        values = np.array(numbers, np.float32)
        values[:, 0], values[:, 1] = np.log1p(values[:, 0]) / 4, np.log1p(values[:, 1]) / 6
        out[:, PATH + WORDS :] = values
    return np.minimum(out, 2.0)
