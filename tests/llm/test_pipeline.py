"""The pipeline stage by stage, and as a whole, against plain Python."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline
import numpy as np
from test_documents import ODD, brute_jaccard, brute_rules, copies, path

from alignscope.llm import packing, quality_rules, weak_quality

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def plain_classifier(spark, rows, docs):
    model = weak_quality.train(docs)
    return [r for r in rows if model.score([r[1] or ""])[0] >= weak_quality.KEEP]


def plain_rules(rows):
    verdicts = []
    for r in rows:
        n, _, symbols, dup_lines, repeat = brute_rules(r[1])
        lines = len([x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)])
        base = n < 50 or 100 * repeat > 50 * n
        verdicts.append((base, symbols > 0.5 * n or dup_lines > 0.5 * lines))
    hosts = {}
    for r, (base, soft) in zip(rows, verdicts, strict=True):
        hosts.setdefault(r[2], []).append(base or soft)
    n, bad = len(rows), sum(sum(h) for h in hosts.values())
    mean = bad / n
    variance = max(sum(sum(h) ** 2 / len(h) for h in hosts.values()) / n - mean * mean, 1e-9)
    strength = max(1.0, min(1000.0, mean * (1 - mean) / variance - 1))
    rate = {k: (sum(h) + mean * strength) / (len(h) + strength) for k, h in hosts.items()}
    return [r for r, (base, soft) in zip(rows, verdicts, strict=True) if not base and rate[r[2]] < quality_rules.REJECTED and not (soft and rate[r[2]] >= quality_rules.DOUBTFUL)]


def plain_copies(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r[1]), r)
    return sorted(first.values())


def plain_near(rows):
    label, _ = brute_jaccard([r[1] for r in rows])
    return [r for k, r in enumerate(rows) if label[k] == k]


def check_pieces(pieces, rows):
    """Each kept document's ids, each once, in sequences without gaps or padding."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    per, sequences = {}, {}
    for r in pieces:
        per.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(per) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        ids, at = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(per[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        total = sum(r["length"] for r in own)
        assert total <= packing.SEQUENCE and total & (total - 1) == 0


def test_stages_against_plain_python(spark, make, prose, monkeypatch):
    texts = [*ODD, *[prose(k, 120) for k in range(60)], *copies(prose, 70, 5), *copies(prose, 71, 3), *[prose(72, 90)] * 4, prose(72, 90).replace(" ", "\n ")]
    texts += [" ".join(w.upper() + "!!" for w in prose(k, 90).split()) for k in range(6)] + [" ".join(w + "***" for w in prose(k, 90).split()) for k in range(6)] + ["a b c " * 60, prose(80, 20), prose(81, 15_000)]
    sources = [["x", "y", "z"][k % 3] for k in range(len(texts) - 20)] + ["bad"] * 20
    docs = make(texts, sources)
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    plain = [lambda rows, docs: plain_classifier(spark, rows, docs), lambda rows, _: plain_rules(rows), lambda rows, _: plain_copies(rows), lambda rows, _: plain_near(rows)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "exact dedup", "n-gram Jaccard join", "packing"]
    now = docs
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain, strict=False):
        out = stage(spark, now, "")
        assert out.columns == docs.columns
        want = brute(rows, now)
        assert sorted((r["doc_id"], r["text"], r["source"]) for r in out.collect()) == sorted(want), name
        assert 0 < len(want) < len(rows), name
        rows, now = sorted(want), out.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else out
    got = corpus_pipeline.run_stages(spark, docs, "")
    assert got.columns == COLUMNS
    check_pieces(got.collect(), rows)


def test_odd_tables(spark, make, prose):
    """Nulls in any column, repeated rows, and nothing at all."""
    assert corpus_pipeline.run_stages(spark, make(["a"]).limit(0), "").count() == 0
    good = [prose(k, 120) for k in range(12)]
    docs = make([*good, None, "", good[0], good[1]], sources=[None] * 16, ids=[*range(10), None, None, None, None, 0, 1], langs=[None] * 16)
    got = corpus_pipeline.run_stages(spark, docs, "").collect()
    assert sorted({r["doc_id"] for r in got if r["doc_id"] is not None}) == list(range(10)) and any(r["doc_id"] is None for r in got)
    assert sum(r["start"] == 0 for r in got) == 12


def test_run(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS
    kept = {r["doc_id"] for r in got.collect()}
    assert 20 < len(kept) <= len(docs)
    check_pieces(got.collect(), [(i, docs[i]) for i in kept])
