"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf texts. A bidirectional LSTM in numpy reads for each leaf the hashed names on its tag
path, all its words hashed and a few numbers, in both directions over the whole page, and labels every leaf as article or
not, so each label depends on the whole document. Pages run together as long as that takes at most ``CELLS`` blocks with
padding; a longer page runs in stretches that hand their states on, which gives the same labels in bounded memory. The model is trained here, on pages made up from a grammar of layouts
(``made_up``) whose labels are known; no page of the input is used for training.

Defined cases: null or empty html gives an empty text; malformed markup is read as far as it goes, and unclosed elements
end with the page; pages of any length are read whole (memory beside the page itself and its texts: 64 bytes a block); each page is
read by itself, so ties and repeated rows need no rule; an empty table gives no rows; other columns, whatever they are
called, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import filled, slices
from .common import named
from .html_blocks import WIDTH, Block, blocks, vectors

HIDDEN, PAGES, EPOCHS, BATCH, SEED = 16, 400, 7, 25, 20
#: Blocks, with padding, that run at once.
CELLS = 1 << 14
SCHEMA = "page_id long, url string, text string, n_chars long"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Labeller:
    """Bidirectional LSTM with one output a block. Arrays are [step, page, feature]; ``mask`` is 1 where a block is."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        scale = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {f"{name}{d}": scale(rows, 4 * hidden) for d in (0, 1) for name, rows in (("x", width), ("h", hidden))}
        for d in (0, 1):
            self.w[f"b{d}"] = np.zeros(4 * hidden, np.float32)
            self.w[f"b{d}"][hidden : 2 * hidden] = 1.0
        self.w |= {"out": scale(2 * hidden + width, 1), "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: int, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, list, tuple[np.ndarray, np.ndarray]]:
        """Hidden values of one direction, what gradients need, and the state at the end."""
        steps, n, _ = x.shape
        k = self.hidden
        z = x.reshape(-1, x.shape[2]) @ self.w[f"x{d}"] + self.w[f"b{d}"]
        z = z.reshape(steps, n, 4 * k)
        h, c = state or (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
        out, tape = np.zeros((steps, n, k), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = z[t] + h @ self.w[f"h{d}"]
            gates = _sigmoid(a[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(a[:, 3 * k :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, tape, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        left, a, _ = self._run(x, mask, 0, keep)
        right, b, _ = self._run(x, mask, 1, keep)
        seen = np.concatenate([left, right, x], 2)
        return (seen @ self.w["out"])[:, :, 0] + self.w["c"], (seen, a, b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z, (seen, *tapes) = self.forward(x, mask, keep=True)
        p = _sigmoid(z)
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        dz = (mask * (p - y) / total).astype(np.float32)
        g = {"out": (seen * dz[:, :, None]).sum((0, 1))[:, None], "c": np.array([dz.sum()], np.float32)}
        k = self.hidden
        dseen = dz[:, :, None] * self.w["out"][:, 0]
        for d, tape in enumerate(tapes):
            dout = dseen[:, :, d * k : (d + 1) * k]
            da_all = np.zeros((*mask.shape, 4 * k), np.float32)
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            gh = np.zeros_like(self.w[f"h{d}"])
            for t, h, c, i, f, o, gg, tanh, m in reversed(tape):
                dh = dh + dout[t]
                inner = m * dh
                dnew = m * dc + inner * o * (1 - tanh * tanh)
                da = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), inner * tanh * o * (1 - o), dnew * i * (1 - gg * gg)], 1)
                da_all[t] = da
                gh += h.T @ da
                dh = (1 - m) * dh + da @ self.w[f"h{d}"].T
                dc = (1 - m) * dc + dnew * f
            flat = da_all.reshape(-1, 4 * k)
            g |= {f"x{d}": x.reshape(len(flat), -1).T @ flat, f"h{d}": gh, f"b{d}": flat.sum(0)}
        return loss, g

    def label(self, pages: list[list[Block]], cells: int = CELLS) -> list[np.ndarray]:
        """True for each block of each page that is article. Pages of about one length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: -len(pages[k]))
        a = 0
        while a < len(order):
            longest = len(pages[order[a]])
            if longest > cells:
                out[order[a]] = self._long(pages[order[a]], cells)
                a += 1
                continue
            some = order[a : a + cells // longest]
            x, mask = padded([vectors(pages[k]) for k in some])
            z, _ = self.forward(x, mask)
            for j, k in enumerate(some):
                out[k] = z[: len(pages[k]), j] > 0
            a += len(some)
        return out

    def _long(self, page: list[Block], stretch: int) -> np.ndarray:
        """The same for one page: from left to right in stretches, then back, where each stretch is decided."""
        k, n = self.hidden, len(page)
        starts = range(0, n, stretch)
        left, state = np.zeros((n, 1, k), np.float32), None
        for a in starts:
            x = vectors(page, a, a + stretch)[:, None]
            left[a : a + stretch], _, state = self._run(x, np.ones(x.shape[:2], np.float32), 0, False, state)
        out, state = np.zeros(n, bool), None
        for a in reversed(starts):
            x = vectors(page, a, a + stretch)[:, None]
            right, _, state = self._run(x, np.ones(x.shape[:2], np.float32), 1, False, state)
            seen = np.concatenate([left[a : a + stretch], right, x], 2)
            out[a : a + stretch] = (seen @ self.w["out"])[:, 0, 0] + self.w["c"] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


#: Words of page furniture, for made-up pages.
FURNITURE = {
    "nav": "home about contact news login products blog archive search menu shop sport tech world help jobs start kontakt accueil inicio".split(),
    "footer": "copyright all rights reserved privacy policy terms of use imprint contact sitemap follow us".split(),
    "notice": "we use cookies to improve your experience accept decline settings this site privacy consent agree".split(),
    "ad": "advertisement sponsored buy now offer sale best price click here limited deal free shipping".split(),
    "form": "subscribe to our newsletter enter your email address name message send submit sign up search".split(),
    "comment": "reply posted by says ago great post thanks i agree comments leave a like report user".split(),
    "aside": "related articles most read popular tags share this on twitter facebook recent posts categories".split(),
}


class _Author:
    """Makes up pages: (html, whether each leaf text in order is article)."""

    def __init__(self, rng: Random) -> None:
        self.rng = rng
        letters = ["aeiou", "bcdfghlmnprstvw", "äöüéèçñßíó"]
        self.parts = ["".join(rng.choice(letters[j % 2 if rng.random() < 0.9 else 2]) for j in range(i % 2, i % 2 + rng.randint(1, 3))) for i in range(40)]
        self.small = ["".join(rng.sample(self.parts, 1)) for _ in range(12)]

    def word(self) -> str:
        return self.rng.choice(self.small) if self.rng.random() < 0.4 else "".join(self.rng.choice(self.parts) for _ in range(self.rng.randint(1, 4)))

    def words(self, n: int, kind: str | None = None) -> str:
        known = FURNITURE.get(kind or "", [])
        return " ".join(self.rng.choice(known) if known and self.rng.random() < 0.6 else self.word() for _ in range(n))

    def sentence(self) -> str:
        return self.words(self.rng.randint(3, 18)).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ",", ""])

    def paragraph(self) -> str:
        noise = self.rng.random()
        text = " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 5, 9])))
        if noise < 0.06:
            text = " ".join(w + self.rng.choice(["***", "%%%", "&amp;&amp;", "$$$", "!!"]) for w in text.split())
        elif noise < 0.09:
            text = text.upper()
        elif noise < 0.12:
            text = " | ".join(text.split())
        elif noise < 0.16:
            text = self.words(self.rng.randint(1, 4))
        return text

    def mark(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 3 and self.rng.random() < 0.2:
            k = self.rng.randrange(len(words))
            tag = self.rng.choice(["b", "i", "em", "strong", "a href='/x'", "span"])
            words[k] = f"<{tag}>{words[k]}</{tag.split()[0]}>"
        return " ".join(words)

    def links(self, kind: str) -> tuple[str, list[bool]]:
        n = self.rng.randint(2, 9)
        items = [self.words(self.rng.randint(1, 3), kind) if self.rng.random() < 0.6 else self.word() for _ in range(n)]
        style = self.rng.random()
        if style < 0.7:
            tag = self.rng.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(items)) + f"</{tag}>", [False] * n
        if style < 0.85:
            return "".join(f'<div><a href="/{k}">{t}</a></div>' for k, t in enumerate(items)), [False] * n
        return " | ".join(f'<a href="/{k}">{t}</a>' for k, t in enumerate(items)), [False]

    def furniture(self, kind: str) -> tuple[str, list[bool]]:
        r = self.rng
        name = {
            "nav": [("nav", ""), ("div", "menu"), ("div", "navbar"), ("ul", "nav menu"), ("nav", "breadcrumb"), ("div", "topnav")],
            "header": [("header", ""), ("div", "header"), ("div", "site-header"), ("div", "masthead"), ("div", "banner")],
            "footer": [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("footer", ""), ("div", "copyright")],
            "aside": [("aside", ""), ("div", "sidebar"), ("aside", "related"), ("div", "widget"), ("section", "related-posts"), ("div", "share")],
            "notice": [("div", "cookie"), ("div", "notice"), ("div", "cookie-banner"), ("div", "alert"), ("div", "consent"), ("p", "notice")],
            "ad": [("div", "ad"), ("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "sponsored"), ("div", "promo"), ("div", "banner-ad"), ("section", "advertisement")],
            "form": [("form", ""), ("form", "newsletter"), ("div", "subscribe"), ("form", "search")],
            "comment": [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "discussion")],
        }[kind]
        tag, cls = r.choice(name)
        attr = r.choice(["class", "class", "id"])
        head = f'<{tag} {attr}="{cls}">' if cls else f"<{tag}>"
        if kind == "comment":
            body, marks = "", []
            if r.random() < 0.6:
                body, marks = f"<h3>{self.words(2, 'comment')}</h3>", [False]
            for _ in range(r.randint(1, 6)):
                inner = r.choice(["div", "li", "article", "p"])
                if inner == "p":
                    body, marks = body + f"<p>{self.mark(self.paragraph())}</p>", [*marks, False]
                else:
                    body += f'<{inner} class="comment"><span class="author">{self.words(2, kind)}</span><p>{self.paragraph()}</p></{inner}>'
                    marks += [False, False]
        elif kind == "form":
            body = f'<label>{self.words(2, kind)}</label><input type="text"><button>{self.words(1, kind)}</button>'
            marks = [False] if "<p>" not in body else [False, False]
            leafs = len(blocks(f"<div>{body}</div>"))
            marks = [False] * leafs
        elif kind in ("nav",) or r.random() < 0.25:
            body, marks = self.links(kind)
        else:
            text = self.paragraph() if r.random() < 0.5 else self.words(r.randint(3, 20), kind)
            if kind == "footer" and r.random() < 0.6:
                text = f"&copy; {self.word()}.example.com &middot; {text}"
            inner = r.choice(["", "", "p", "div", "h2" if kind in ("header", "aside") else "p"])
            body, marks = (f"<{inner}>{text}</{inner}>" if inner else text), [False]
        return f"{head}{body}</{tag}>", marks

    def article(self) -> tuple[str, list[bool]]:
        r = self.rng
        opened, closed = r.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post">', "</div>"), ('<section class="article-body">', "</section>"), ('<div class="entry">', "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("", "")])
        body, marks = "", []
        if r.random() < 0.85:
            body, marks = f"<h1>{self.words(r.randint(1, 9)).capitalize()}</h1>", [True]
        broken = r.random() < 0.3  # unclosed paragraphs and line breaks
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            x = r.random()
            if x < 0.05:
                body, marks = body + f"<h2>{self.words(r.randint(1, 5))}</h2>", [*marks, True]
            elif x < 0.09:
                items = [self.sentence() for _ in range(r.randint(2, 5))]
                body, marks = body + "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>", marks + [True] * len(items)
            elif x < 0.12:
                body, marks = body + f"<blockquote>{self.paragraph()}</blockquote>", [*marks, True]
            elif x < 0.15:
                inside, off = self.furniture("ad")
                body, marks = body + inside, marks + off
            elif broken and x < 0.5:
                body, marks = body + f"<p><b>{self.paragraph()}<br>", [*marks, True]
            elif broken and x < 0.6:
                body, marks = body + f"<p>{self.paragraph()}<br>{self.paragraph()}", [*marks, True, True]
            else:
                body, marks = body + f"<p>{self.mark(self.paragraph())}</p>", [*marks, True]
        return opened + body + closed, marks

    def page(self) -> tuple[str, list[bool]]:
        r = self.rng
        parts: list[tuple[str, list[bool]]] = []
        maybe = lambda kind, chance: parts.append(self.furniture(kind)) if r.random() < chance else None
        for kind, chance in (("notice", 0.2), ("header", 0.3), ("nav", 0.85), ("ad", 0.6), ("form", 0.15), ("aside", 0.2)):
            maybe(kind, chance)
        if r.random() < 0.2:
            r.shuffle(parts)
        parts.append(self.article())
        for kind, chance in (("ad", 0.2), ("aside", 0.3), ("comment", 0.35), ("form", 0.2), ("nav", 0.1), ("notice", 0.1), ("footer", 0.85)):
            maybe(kind, chance)
        html = f"<!DOCTYPE html><html><head><title>{self.words(5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>" + "".join(h for h, _ in parts) + "</body></html>"
        return html, [m for _, ms in parts for m in ms]


def made_up(n: int, seed: int = SEED) -> list[tuple[str, list[Block], np.ndarray]]:
    """Pages of many layouts, with the label of every leaf text; pages whose leaves don't match their labels are left out."""
    rng = Random(seed)
    out = []
    while len(out) < n:
        html, marks = _Author(rng).page()
        page = blocks(html)
        if len(page) == len(marks):
            out.append((html, page, np.array(marks, np.float32)))
    return out


_TRAINED: dict[tuple, Labeller] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, trained with Adam on made-up pages; once per process."""
    if (pages, epochs, seed) in _TRAINED:
        return _TRAINED[pages, epochs, seed]
    model, data = Labeller(seed=seed), [(vectors(page), y) for _, page, y in made_up(pages, seed)]
    rng = np.random.default_rng(seed)
    data.sort(key=lambda d: len(d[0]))
    groups = [data[a : a + BATCH] for a in range(0, len(data), BATCH)]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    t = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = padded([v for v, _ in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for j, (_, marks) in enumerate(groups[g]):
                y[: len(marks), j] = marks
            _, grads = model.gradients(x, mask, y)
            t += 1
            rate = 0.02 * (1 - 0.8 * epoch / epochs)
            for k, d in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                model.w[k] = model.w[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    _TRAINED[pages, epochs, seed] = model
    return model


def main_text(pages: list[str], model: Labeller) -> list[str]:
    parsed = [blocks(p) for p in pages]
    labels = model.label(parsed)
    return [" ".join([b.text for b, good in zip(page, label, strict=True) if good]) for page, label in zip(parsed, labels, strict=True)]


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = filled(batch.column(2))
            for a, b in slices(raw, 2 << 20):
                texts = main_text(raw.slice(a, b - a).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(named(page_id).cast("long").alias("page_id"), named(url).alias("url"), named(html).cast("string").alias("html")).mapInArrow(run, SCHEMA)
