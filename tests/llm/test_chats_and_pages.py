"""Chat formatting as an exact round trip, and main text of made-up and of stored pages."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from alignscope.llm import chat_format, html_blocks, html_extract

TEXTS = ["hi", "", None, "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "\\<|im_turn|>\\\\", "a\\", "[\\INST]", "<<SYS>>é漢\n", "<|im_turn|>", "<s><s>"]


def read(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, `a.b` int")
    chats = chat_format.format_chats(turns)
    back = chats.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: r for r in back.collect()}


def test_round_trip(spark):
    rows = [(0, i, ["user", "assistant", "user", "user"][i % 4], t) for i, t in enumerate(TEXTS)]
    rows += [(1, 0, "odd\n<role>%[x", "a"), (1, 1, None, "b"), (2, None, "assistant", "first"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    got = read(spark, rows)
    want = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == [t for r, t in turns if r == "assistant"]
    inside = got[0]["formatted"]
    blocks = sum(1 for k, r in enumerate(want[0]) if k == 0 or want[0][k - 1][0] != r[0])
    assert inside.count(chat_format.OPEN) == blocks == inside.count(chat_format.CLOSE) and "</s>" not in inside and "[INST]" not in inside


def test_long_conversation(spark):
    rows = [(5, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1500)]
    got = read(spark, rows)[5]
    assert len(got["turns"]) == 1500 and "".join(got["loss"]) == "".join(f"t{k}" for k in range(0, 1500, 2))
    long = "</s>[INST] é \\ " * 300_000  # a text of 4 MB
    got = read(spark, [(6, 0, "user", "q"), (6, 1, "assistant", long)])[6]
    assert got["turns"][1]["text"] == long and got["loss"] == [long] and "</s>" not in got["formatted"]


def test_empty_table(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_digests(spark):
    from alignscope.llm.queries import op10_chat_format

    said = "</s>[INST] ok [/INST]"
    r = op10_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_blocks():
    page = html_blocks.blocks("<p>a&amp;b <b>c</b>d<br>e<p>f<script>x</p></script><ul><li><a href='>'>g</a><!-- n --> h</ul><div>i")
    assert [b.text for b in page] == ["a&b cd", "e", "f", "g h", "i"]
    assert page[3].linked == 1 and "li" in page[3].path and "ul" not in page[4].path
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("x<p")] == ["x<p"]


def test_blocks_of_valid_short_forms():
    """A self-closed svg is empty, and a head without an end tag ends where the body begins."""
    texts = lambda html: [b.text for b in html_blocks.blocks(html)]
    assert texts("<p>a</p><svg/><p>b</p><svg class='x>/' href=/i/j /><p>c</p><svg><text>no</text></svg>d") == ["a", "b", "c", "d"]
    assert texts("<p>a</p><svg viewBox='0 0 1 1'><path d='M0'/></svg><p>b</p><svg width=1>x") == ["a", "b"]
    for start in ("<body>", "<body class=x>", "", "<div>"):
        page = html_blocks.blocks(f"<html><head><meta charset=utf-8><title>no</title><link href=x><style>p{{}}</style>{start}<p>a<article>b</article>")
        assert [b.text for b in page] == ["a", "b"] and "head" not in page[1].path
    assert texts("<head><title>no</title> <meta>a <b>b</b><p>c") == ["a b", "c"] and texts("<head><head><body>a") == ["a"]
    assert texts("<head><noscript><p>no</p></noscript><script>1</script></head>x") == ["x"]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller(width=html_blocks.WIDTH, hidden=3, seed=1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, mask, y = rng.random((4, 2, html_blocks.WIDTH)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float), rng.integers(0, 2, (4, 2)).astype(float)
    _, grads = model.gradients(x, mask, y)
    for name in ("h0", "h1", "b0", "x1", "out", "c"):
        flat = model.w[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        was = flat[k]
        flat[k] = was + 1e-3
        up, _ = model.gradients(x, mask, y)
        flat[k] = was - 1e-3
        down, _ = model.gradients(x, mask, y)
        flat[k] = was
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[k]) < 1e-3


def agreement(model, pages):
    marks = model.label([p for _, p, _ in pages])
    return np.mean([(m == (y > 0.5)).mean() for m, (_, _, y) in zip(marks, pages, strict=True)])


def test_labels_of_unseen_pages():
    model = html_extract.trained()
    pages = html_extract.made_up(200, seed=77)
    assert agreement(model, pages) > 0.98
    hints = re.compile(r"<(?:article|main)\b|content|class=\"(?:post|entry)\"|article-body")
    plain = [p for p in pages if not hints.search(p[0])]
    assert len(plain) > 10 and agreement(model, plain) > 0.96


def test_stored_pages_without_article_tags(spark):
    """The label doesn't hang on the tag: without it every block of the stored pages keeps its label."""
    model = html_extract.trained()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        marked = html_blocks.blocks(r["html"])
        bare = html_blocks.blocks(re.sub(r"</?article[^>]*>", "", r["html"]))
        if len(marked) == len(bare):
            assert model.label([bare])[0].tolist() == ["article" in b.path for b in marked]


def test_all_words_of_a_block_count():
    block = lambda middle: html_blocks.Block(" ".join(["same"] * 100 + [middle] * 60 + ["same"] * 100), ("p",), 0)
    a, b = html_blocks.vectors([block("subscribe")]), html_blocks.vectors([block("chapters")])
    assert abs(a - b).max() > 0.5


def test_stretches_give_the_same_labels():
    model = html_extract.trained()
    pages = [p for _, p, _ in html_extract.made_up(60, seed=5)]
    whole = model.label(pages)
    for cells in (1, 7, 40, 300):
        assert all((x == y).all() for x, y in zip(whole, model.label(pages, cells), strict=True))


def test_memory_of_a_long_page():
    """A page of 5 MB in short paragraphs beside small ones."""
    code = """
import resource, numpy as np
from alignscope.llm import html_extract as h
small = [p for p, _, _ in h.made_up(60, seed=3)]
model = h.trained()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
texts = h.main_text([*small, "<article>" + "<p>ab c</p>" * 450_000 + "</article>"], model)
assert texts[:60] == h.main_text(small, model)
assert len(texts[60]) > 1_000_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = str(Path(__file__).resolve().parent.parent.parent)
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root}, check=False)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 500


def test_extract(spark):
    good = "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>Title here</h1><p>One fine  long sentence, told well.</p><p>Another &lt;one&gt; follows it.</p></article><footer>&copy; x.example.com</footer></body></html>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain words only"), (4, "u", good), (4, "u", good), (5, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, n_chars int, `a.b` string")
    got = {}
    for r in html_extract.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert got[1][0]["text"] == got[2][0]["text"] == "" and len(got[4]) == 2
    assert got[4][0]["text"] == "Title here One fine long sentence, told well. Another <one> follows it."
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_stored_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inside = [b.text for b in html_blocks.blocks(r["html"]) if "article" in b.path]
        assert got[r["page_id"]] == " ".join(inside)
