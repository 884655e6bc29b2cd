"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from alignscope.llm import byte_bpe, exact_dedup, jaccard_join, language_id, license_scan, packing, quality_rules, weak_quality

ODD = [None, "", " \t\n", "a", "a  b\nc", "a b c", "a b c", "\n\n", "é" * 3, "x" * 5000]


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_exact_dedup(make, prose):
    texts = [*ODD, prose(1, 80), prose(1, 80).replace(" ", "\n "), prose(2, 50), *[prose(3, 20)] * 40]
    docs = make([*texts, texts[3]], ids=[*range(len(texts)), 3])  # a repeated row
    got = exact_dedup.label_copies(docs).collect()
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    for i, t in [*enumerate(norm), (3, norm[3])]:
        groups.setdefault(t, []).append(i)
    assert len(got) == len(texts) + 1
    for r in got:
        same = groups[norm[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (min(same), len(same), hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest())
    assert sorted(r["keep_id"] for r in got if r["kept"]) == sorted(min(g) for g in groups.values())
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_dedup.label_copies(docs.limit(0)).count() == exact_dedup.drop_copies(docs.limit(0)).count() == 0
    assert exact_dedup.label_copies(make(["a", "b"], ids=[None, None])).count() == 2


def test_exact_dedup_in_ranges(make, prose):
    """With a filter that fits in no broadcast at once, rows are tested range by range; the result is the same."""
    texts = [*ODD, *[prose(k % 200, 30) for k in range(400)]]
    docs = make(texts)
    want = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.label_copies(docs).collect()}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.label_copies(docs, filter_bytes=100).collect()} == want
    kept = exact_dedup.drop_copies(docs, filter_bytes=100)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, _, k in want if k)


def test_exact_dedup_shuffles_no_single_row(make, prose):
    """On the main path, rows that the filter doesn't hold meet no exchange, and their texts aren't shuffled."""
    docs = make([prose(k % 300, 40) for k in range(310)])
    plan = exact_dedup.drop_copies(docs)._jdf.queryExecution().executedPlan().toString().split("Union")[1]
    single, rest = plan.split("HashAggregate", 1)[0] if "HashAggregate" in plan else plan, plan
    branch = plan[: plan.index("min_by")] if "min_by" in plan else single
    assert "BroadcastHashJoin" in branch and "hashpartitioning" not in branch and "SortMergeJoin" not in plan and "min_by" in rest


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(make, prose):
    texts = [*ODD, "a b c " * 60, "a a a a", "x | y\n" * 80, *[prose(k, 200) for k in range(30)], *["# # #"] * 30]
    sources = [None, *["good"] * (len(texts) - 31), *["bad"] * 30]
    docs = make(texts, sources)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        counts = brute_rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert all(got[i]["kept"] for i in range(len(texts)) if 13 <= i < 43)
    assert got[len(texts) - 1]["host_rate"] > 0.6
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality_rules.judge(docs.limit(0)).count() == quality_rules.keep_good(docs.limit(0)).count() == 0


def test_rejected_host_loses_good_documents(make, prose):
    docs = make(["short"] * 95 + [prose(k, 120) for k in range(105)], ["spam"] * 100 + ["fine"] * 100)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert not any(got[i] for i in range(100)) and all(got[i] for i in range(100, 200))


def brute_jaccard(texts):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    n = len(texts)
    near = [[bool(sets[a]) and a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for b in range(n)] for a in range(n)]
    label = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if near[a][b]:
                    label[a] = min(label[a], label[b])
    return label, [sum(r) for r in near]


def copies(prose, seed, many, words=150):
    base = prose(seed, words).split()
    out = []
    for k in range(many):
        w = list(base)
        w[(7 * k) % words] = f"new{k}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cap", [1024, 3])
def test_jaccard_join(make, prose, monkeypatch, cap):
    """With a tiny cap, buckets are split, what can't be split becomes a star, and groups are verified in blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET", cap)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", cap)
    texts = [*ODD, *copies(prose, 1, 12), *copies(prose, 2, 4), *[prose(3, 60)] * 5, *[prose(k, 90) for k in range(10, 20)]]
    docs = make(texts)
    label, links = brute_jaccard(texts)
    got = {r["doc_id"]: r for r in jaccard_join.join_near(docs).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == label
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_jaccard_join_odd_tables(make, prose):
    assert jaccard_join.join_near(make(["a"]).limit(0)).count() == 0
    same = make([prose(1, 60)] * 3 + ["z"], ids=[5, 5, None, None])
    assert jaccard_join.join_near(same).count() == 4
    assert jaccard_join.drop_near_copies(make([prose(1, 60)] * 3, ids=[5, 5, 5])).count() == 1


def test_jaccard_keeps_one_of_each_class_without_ids(make, prose):
    """Rows with null or equal ids are told apart by their texts."""
    a, b = copies(prose, 5, 3), copies(prose, 6, 2)
    for ids in ([None] * 7, [4] * 7):
        docs = make([*a, *b, a[0], prose(7, 80)], ids=ids)
        kept = [r["text"] for r in jaccard_join.drop_near_copies(docs).collect()]
        assert len(kept) == 3 and sum(t in a for t in kept) == 1 and sum(t in b for t in kept) == 1
        assert sorted(r["n_links"] for r in jaccard_join.join_near(docs).collect()) == [0, 1, 1, 3, 3, 3, 3]


def test_jaccard_recall(make, prose):
    """Pairs near the threshold against brute force: ids divisible by 100 against all rows."""
    from random import Random

    rng = Random(3)
    texts, words = [], 120
    for k in range(900):
        base = prose(1000 + k, words).split()
        other = list(base)
        at = rng.sample(range(0, words, 6), rng.choice([1, 2, 2, 3, 3]))  # five words a change: similarity from 0.7
        for i in at:
            other[i] = f"x{k}y{i}"
        texts += [" ".join(base), " ".join(other)]
    # the pairs' rows stand at 100 k and 100 k + 1, and one after another between
    ids = [100 * (i // 2) + i % 2 for i in range(len(texts))]
    sets = [set(zip(*(t.split()[j:] for j in range(5)), strict=False)) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.join_near(make(texts, ids=ids)).collect()}
    want = found = close = 0
    for i, s in enumerate(sets):
        if ids[i] % 100 == 0:
            others = {j for x in s for j in holders[x]} - {i}
            near = [j for j in others if 5 * len(s & sets[j]) >= 4 * len(s | sets[j])]
            close += sum(100 * len(s & sets[j]) < 86 * len(s | sets[j]) for j in near)
            want += len(near)
            found += min(got[ids[i]], len(near))
            assert got[ids[i]] <= len(near)
    assert close > 200 and found >= 0.99 * want


def test_components(spark, tmp_path):
    """Chains, a hub and rings against union by hand; no number of rounds ends them."""
    from alignscope.llm.common import Tables
    from alignscope.llm.components import components

    chain = [(k, k + 1) for k in range(2000)]
    hub = [(5000, 5000 + k) for k in range(1, 3000)]
    ring = [(9000 + k, 9000 + (k + 1) % 50) for k in range(50)]
    with Tables(spark) as tables:
        links = spark.createDataFrame([*chain, *hub, *ring, (9999, 9999)], "a long, b long").repartition(4)
        got = {r["node"]: r["label"] for r in components(links, tables).collect()}
        assert components(links.limit(0), tables).count() == 0
    want = {**{k: 0 for k in range(2001)}, **{k: 5000 for k in range(5000, 8000)}, **{k: 9000 for k in range(9000, 9050)}}
    assert got == want


def test_weak_quality(make, prose):
    good = [prose(k, 150) for k in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(k, 90).split()) for k in range(15)] + [" ".join(w + "***" for w in prose(k, 90).split()) for k in range(15)] + [" | ".join(prose(k, 90).split()) for k in range(10)] + [f"{prose(k, 1)} " * 60 for k in range(10)]
    docs = make([*good, *bad, None, ""])
    model = weak_quality.train(docs)
    got = {r["doc_id"]: r for r in weak_quality.score(docs, model).collect()}
    assert sum(got[i]["kept"] for i in range(120)) >= 118
    assert sum(not got[i]["kept"] for i in range(120, 170)) >= 45
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = weak_quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert weak_quality.score(docs.limit(0), weak_quality.train(docs.limit(0))).count() == 0
    assert weak_quality.keep_good(docs.limit(0)).count() == 0
    long = make([prose(3, 60_000), " ".join(w.upper() + "!!" for w in prose(4, 60_000).split())])
    assert {r["doc_id"]: r["kept"] for r in weak_quality.score(long, model).collect()} == {0: True, 1: False}


def test_estimate_against_brute_force():
    """EM document by document in plain Python gives the posteriors that EM on counts of patterns gives."""
    import math
    from random import Random

    rng = Random(4)
    k = len(weak_quality.LABELLERS)
    votes = []
    for _ in range(300):
        good = rng.random() < 0.8
        votes.append([0 if (x := rng.random()) < 0.1 else 1 + (x < (0.12 if good else 0.5)) for _ in range(k)])
    number = [int("".join(map(str, v)), 3) for v in votes]
    patterns, counts = np.unique(number, return_counts=True)
    post, _, prior = weak_quality.estimate(patterns, counts.astype(float), rounds=25)
    known = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    belief = [[[b * (1 + weak_quality.BELIEF_SHARE * len(votes)) for b in row]] * k for row in weak_quality.BELIEF.tolist()]
    p = [(v.count(1) + 1) / (v.count(1) + 10 * v.count(2) + 2) for v in votes]
    for _ in range(25):
        theta = [[list(c) for c in belief[y]] for y in (0, 1)]
        for v, g in zip(votes, p, strict=True):
            for j, x in enumerate(v):
                theta[0][j][x] += 1 - g
                theta[1][j][x] += g
        theta = [[[x / sum(row) for x in row] for row in c] for c in theta]
        share = (sum(p) + 1) / (len(p) + 2)
        p = [1 / (1 + math.exp(-(math.log(share / (1 - share)) + sum(math.log(theta[1][j][x] / theta[0][j][x]) for j, x in enumerate(v))))) for v in votes]
    assert max(abs(known[n] - g) for n, g in zip(number, p, strict=True)) < 1e-6 and abs(prior - share) < 1e-6


def test_scorer_against_brute_force(prose):
    rng = np.random.default_rng(2)
    model = weak_quality.Model(rng.normal(size=weak_quality.SHAPES + weak_quality.GRAMS + weak_quality.ECHOES), 0.1, 0.7)
    texts = [prose(1, 30), "a", "", "ab cd ab", prose(2, 3000)]
    for t, got in zip(texts, model.score(texts), strict=True):
        shape, gram, _ = weak_quality.features(*weak_quality.decode([t]))
        words = t.split()
        echo = [sum((i >= b and words[i - b] == w) << (b - 1) for b in range(1, 5)) for i, w in enumerate(words)]
        if not len(shape):
            assert got == 0.7
            continue
        z = 0.1 + sum(model.weights[i] for i in [*shape, *gram]) / len(shape) + sum(model.weights[e + weak_quality.SHAPES + weak_quality.GRAMS] for e in echo) / len(words)
        assert abs(1 / (1 + np.exp(-z)) - got) < 1e-4


def test_sample_ignores_ids(make, prose, monkeypatch):
    """Null ids or one repeated id, and copies, neither empty nor flood the sample."""
    texts = [*[prose(k, 60) for k in range(80)], *[prose(999, 60)] * 60, *["!!! ### $$$ !!! " * 20 + str(k) for k in range(20)]]
    drawn = []
    fit = weak_quality.fit
    monkeypatch.setattr(weak_quality, "fit", lambda rows, labels: drawn.append(len(rows)) or fit(rows, labels))
    scores = []
    for ids in (range(len(texts)), [None] * len(texts), [7] * len(texts)):
        docs = make(texts, ids=ids)
        scores.append(sorted(round(r["score"], 6) for r in weak_quality.score(docs, weak_quality.train(docs, sample=60, bound=50)).collect()))
    assert scores[0] == scores[1] == scores[2] and drawn[0] == drawn[1] == drawn[2] and 10 < drawn[0] <= 50


def test_weak_quality_against_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    met = weak_quality.score(docs, weak_quality.train(docs)).join(labels, "doc_id").collect()
    good, bad = [r["kept"] for r in met if r["quality"] == 1], [not r["kept"] for r in met if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.9


def test_language_id(make):
    texts = {"aa": "lorem ipsum dolor sit amet consetetur ", "bb": "kivi talo metsa jarvi yksi kaksi "}
    rows = [(texts[k] * n, k) for k in texts for n in range(3, 20)] + [(None, "aa"), ("", "bb"), ("12 ?!", "aa"), ("lorem dolor", None), ("é", None)]
    docs = make([t for t, _ in rows], langs=[k for _, k in rows])
    got = {r["doc_id"]: r for r in language_id.classify(docs, language_id.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == k for i, (_, k) in enumerate(rows[:34]))
    assert [got[i]["lang_pred"] for i in (34, 35, 36)] == ["und"] * 3 and got[37]["lang_pred"] == "aa"
    assert got[38]["lang_pred"] in ("aa", "bb") and got[38]["score"] == 0
    assert language_id.classify(docs.limit(0), language_id.train(docs.limit(0))).count() == 0
    assert language_id.classify(docs, language_id.train(docs.limit(0))).where("lang_pred = 'und'").count() == len(rows)


def test_language_id_against_sets(make, prose):
    """Predictions are those of exact sets of n-grams; texts that two languages know alike go to the first."""
    from random import Random

    rng = Random(6)
    tongues = {f"l{k}": ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(40)] for k in range(5)}
    rows = [(" ".join(rng.choice(w) for _ in range(25)), k) for k, w in tongues.items() for _ in range(12)]
    rows += [("zz qq xx", "l3"), ("zz qq xx", "l4"), ("zz qq xx", None), ("zz qq xx", None)]
    docs = make([t for t, _ in rows], langs=[k for _, k in rows])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.classify(docs, language_id.train(docs)).collect()}
    gram = lambda t: [f"  {t} "[i : i + 4] for i in range(len(t))]
    sets = {k: set().union(*[gram(t) for t, n in rows if n == k]) for k in tongues}
    for i, (t, _) in enumerate(rows):
        hits = {k: sum(g in s for g in gram(t)) for k, s in sets.items()}
        best = max(hits.values())
        assert got[i] == min(k for k, h in hits.items() if h == best)
    # copies don't change the sample, and neither do ids
    again = make([t for t, _ in rows] * 2, langs=[k for _, k in rows] * 2, ids=[None] * (2 * len(rows)))
    assert all((a == b).all() for a, b in zip(language_id.train(docs).planes, language_id.train(again).planes, strict=True))


def test_many_languages(make):
    """1,100 languages of a text each: none is dropped, and n-grams seen once are learned."""
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3)) * 2
    docs = make([f"{word(k)} {word(k)}x" for k in range(1100)], langs=[f"l{k:04}" for k in range(1100)])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.classify(docs, language_id.train(docs)).collect()}
    assert sum(got[k] == f"l{k:04}" for k in range(1100)) > 1090


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out()
    named = language_id.classify(docs, language_id.train(docs.where(~held))).where(held)
    met = named.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in met]) > 0.98


def test_packing(make, prose):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = [*ODD, *[prose(k, 40 * k) for k in range(1, 30)], prose(99, 9000), "Straße İstanbul 漢字 don't 12a ﬁn  ÀÉ"]
    texts += ["end <|endoftext|> go", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "İ<|endoftext|>ß", "x" * 300_000]
    pool = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\n", "'s", "İ", "ß", "a", "B", "9", "é", "e\u0301", "漢", "\x1c", "\u2028", "ﬁ"]
    rng = np.random.default_rng(8)
    texts += ["".join(rng.choice(pool, 25)) for _ in range(300)]
    rows = packing.pack_documents(make(texts), path("word_bpe_49k.json")).collect()
    per, sequences = {}, {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(per[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE and at & (at - 1) == 0
    assert packing.pack_documents(make(["a"]).limit(0), path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError, match="other settings"):
        packing.WordTokenizer(path("byte_bpe_50k.json"))
    same = packing.pack_documents(make(["a b"] * 3, ids=[1, 1, None]), path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in same) == 9 and {(r["doc_id"], r["doc_tokens"]) for r in same} == {(1, 3), (None, 3)}


def test_packing_remembers_little():
    """What a worker keeps of 300,000 different words is bounded in bytes, and frequent words that stay have their ids."""
    import tracemalloc

    import pyarrow as pa

    coder = packing.WordTokenizer(path("word_bpe_49k.json"))
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for k in range(0, 300_000, 10_000):
        coder.encode(pa.array([" ".join(f"the Né{i:x}," for i in range(k, k + 10_000))], pa.large_string()))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 24 << 20


def test_classifier_sends_texts_once(make, prose):
    """Texts go to Python in one column, also beside others; a column that isn't a string is read as one."""
    docs = make([*[prose(k, 80) for k in range(30)], None])
    kept = weak_quality.keep_good(docs)
    assert "cast(text#" not in kept._jdf.queryExecution().analyzed().toString() and kept.columns == docs.columns
    raw = docs.withColumn("text", docs["text"].cast("binary"))
    assert sorted(r["doc_id"] for r in weak_quality.keep_good(raw).collect()) == sorted(r["doc_id"] for r in kept.collect())


def test_packing_forgets_rightly(monkeypatch, prose):
    """Whatever is remembered, forgotten or too long to remember, ids are those of the library."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = [prose(k % 7, 60 + k) + " Don't, 漢字 <|endoftext|>a " + "y" * (k % 5) * 9 + f" w{k}" for k in range(60)] + ["", " ", "İ", "<|endoftext|>"]
    for cache, longest, together in [(1, 256, 1 << 15), (40, 6, 3), (10_000, 4, 7), (10_000, 0, 1)]:
        for name, value in (("CACHE", cache), ("LONGEST", longest), ("TOGETHER", together)):
            monkeypatch.setattr(packing, name, value)
        coder = packing.WordTokenizer(path("word_bpe_49k.json"))
        for k in range(0, len(texts), 8):
            ids, begins = coder.encode(pa.array(texts[k : k + 8], pa.large_string()))
            for i, t in enumerate(texts[k : k + 8]):
                assert ids[begins[i] : begins[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids
            assert all(len(known.names) == len(known.runs.lens) <= cache for known in (coder.chunks, coder.words))


def test_packing_balances_costs():
    rng = np.random.default_rng(1)
    pieces = [packing.Piece(i, 0, n, np.zeros(n, np.uint16)) for i, n in enumerate(rng.integers(10, 3000, 400).tolist())]
    full, left = packing.pack(pieces, False)
    costs = [sum(packing.cost(len(p.ids)) for p in s) for s in full]
    random = [sum(packing.cost(int(n)) for n in rng.permutation([len(p.ids) for p in pieces])[:3]) for _ in full]
    assert all(sum(len(p.ids) for p in s) == packing.SEQUENCE for s in full) and sum(len(p.ids) for p in left) < packing.SEQUENCE
    assert np.std(costs) < np.std(random)


def test_byte_bpe(make, prose):
    import public_tokenizers as P
    import tiktoken

    bpe = byte_bpe.coder(path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    pool = ["a", "th", "ing", " ", "  ", "\n", "é", "漢", "🙂", "1", "'s", "!!", " ", "\x1c", "</s>", "ß"]
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    texts = [*ODD, prose(4, 400), "aaaa" * 500, "ab" * 700, "y" * 400_000, *["".join(rng.choice(pool, 30)) for _ in range(60)]]
    texts += ["".join(f"a{c}1 {c}{c}\n" for c in every[k : k + 9000]) for k in range(0, len(every), 9000)]  # every code point
    texts += ["".join(every[k] for k in rng.integers(0, len(every), 30)) for _ in range(200)]
    for r in byte_bpe.encode_documents(make(texts), path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]] or "")
    for r in byte_bpe.digest_documents(make(texts), path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        t = texts[r["doc_id"]] or ""
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    other = r"\p{L}+ \p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]|\p{L}"  # matches go on over spaces
    odd = tiktoken.Encoding("odd", pat_str=other, mergeable_ranks=bpe.ranks, special_tokens={})
    some = [*ODD, prose(4, 40), "a b c d 12345 ef gh", "\u19038 b"]
    for r in byte_bpe.encode_documents(make(some), path("byte_bpe_multi_50k.tiktoken"), other).collect():
        assert r["ids"] == odd.encode_ordinary(some[r["doc_id"]] or "")
    assert byte_bpe.digest_documents(make(["a"]).limit(0), path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_license_scan(spark, prose, monkeypatch):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (0, "a/b/LICENSE", mit), (1, "a/b/c/x.txt", prose(1, 80)), (2, "a/y.txt", prose(2, 80)), (3, "a/b/c/z.txt", f"{prose(3, 60)}\n{gpl}\n{prose(4, 60)}"),
        (4, None, None), (5, "q/COPYING", gpl), (6, "q/r/s/t.txt", ""), (6, "q/r/s/t.txt", ""), (7, "", "licensed license version"),
        (8, "m/n.txt", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."),
        (9, "cc/d.txt", prose(5, 90) + "\nLicensed under CC BY-NC 4.0."), (10, "long/LICENSE", prose(6, 30_000) + "\n" + mit), (11, "long/x/e.txt", ""), (12, "pad/f.txt", " " * 9000 + "\n" + mit), (13, "pad/g.txt", None),
        (14, "tail/h.txt", mit + "\n" + "漢字 " * 3 + " " * 5000 + prose(7, 40)), (15, "tail/i.txt", ""), (16, "tie/LICENSE", mit), (17, "tie/COPYING", gpl), (18, "tie/j.txt", ""), (None, "a/b/k.txt", ""),
    ]
    files = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, path string, text string, `a.b` int, dir string")
    got = {}
    for r in license_scan.scan(files).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["how"], r["license_dir"]))
    assert got[0] == [("MIT", "own", None)] and got[1] == [("MIT", "inherited", "a/b")] and got[2] == [(None, None, None)]
    assert got[3] == [("GPL-3.0", "own", None)] and got[6] == [("GPL-3.0", "inherited", "q")] * 2 and got[4] == [(None, None, None)]
    assert got[8] == [("Apache-2.0", "own", None)] and got[9] == [("CC-BY-NC-4.0", "own", None)]
    # whole texts: a notice after 100,000 characters counts, blanks are no words, and late words are
    assert got[10] == [("MIT", "own", None)] and got[11] == [("MIT", "inherited", "long")] and got[13] == [("MIT", "inherited", "pad")] and got[15] == [(None, None, None)]
    assert got[18] == [("GPL-3.0", "inherited", "tie")] and got[None] == [("MIT", "inherited", "a/b")]
    assert license_scan.scan(files.limit(0)).count() == 0
    monkeypatch.setattr(license_scan, "fits_broadcast", lambda rows, size: False)
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan(files).collect()} == {(i, v[0][0]) for i, v in got.items()}


SHARE = {"the": 0.9, "of": 0.8, "is": 0.7, "this": 0.6, "to": 0.8, "in": 0.7, "or": 0.5, "file": 0.3, "under": 0.2, "license": 0.1, "released": 0.05, "mit": 0.04, "version": 0.02}


def matcher(n=1000):
    return license_scan.Matcher({w: int(s * n) for w, s in SHARE.items()}, n)


def test_notices_with_extra_words():
    """Words around a notice don't hide it, and only shares of files count, not the number of files."""
    lines = ["Foo is released under the MIT License.", "Copyright 2020 Acme. Released under the MIT License.", "This file is released under the MIT License, see below.", " ".join(["word"] * 300) + " Released under the MIT License. " + " ".join(["more"] * 300)]
    for line in [*lines, *(f"odd\n{x}\nodd" for x in lines)]:
        got = [matcher(n).scan(line) for n in (1000, 10_000, 10_000_000)]
        assert got[0][0] == "MIT" and got[0][1] > 0.99 and len(set(got)) == 1
    assert matcher().scan("this is the license of the version")[0] is None


GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        (GPL2, "GPL-2.0"),
        (GPL2.replace("version 2", "version 3"), "GPL-3.0"),
        (GPL2.replace("General", "Lesser General").replace("version 2", "version 2.1").replace("program", "library"), "LGPL-2.1"),
        (GPL2.replace("General", "Affero General").replace("version 2", "version 3"), "AGPL-3.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n 51 Franklin Street, Fifth Floor", "GPL-2.0"),
        ("\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0"),
        ("This file is not licensed under the Apache License, Version 2.0.", None),
        ("Not licensed under the MIT License.", None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under\nthe\nMIT\nLicense", "MIT"),
        (license_scan.GRANT[:90] + "\n * x\n" + license_scan.GRANT[90:], "MIT"),
        (license_scan.REDISTRIBUTION + license_scan.CLAUSES + license_scan.BSD_DISCLAIMER, "BSD-2-Clause"),
        (license_scan.REDISTRIBUTION + license_scan.CLAUSES + license_scan.NO_ENDORSEMENT + license_scan.BSD_DISCLAIMER, "BSD-3-Clause"),
    ],
)
def test_licences_as_they_stand_in_files(text, licence):
    around = "Some words of the file itself, of no licence.\n"
    for t in (text, around + text + "\n" + around, text + "\n" + around * 400):
        assert matcher().scan(t)[0] == licence


def test_every_template_finds_itself():
    m = matcher()
    for name, t in license_scan.TEMPLATES:
        assert m.scan(t)[0] == name, t
        assert m.scan("\n".join(t.split(" ")))[0] == name, t


def test_passages_against_brute_force():
    """The best passage of a text is that of all lines and of all runs of words as long as a template."""
    from random import Random

    rng, m = Random(2), matcher()
    pool = [w for _, t in license_scan.TEMPLATES for w in license_scan.words(t)] + ["odd", "word", "\n", "\n"] * 60
    for k in range(60):
        notice = license_scan.words(license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)][1])
        for _ in range(rng.randint(0, 3)):
            notice[rng.randrange(len(notice))] = rng.choice(["odd", "word", "\n"])
        text = " ".join([rng.choice(pool) for _ in range(rng.randint(1, 30))] + notice + [rng.choice(pool) for _ in range(rng.randint(1, 40))])
        whole, ends = [], [0]
        for line in text.split("\n"):
            whole += license_scan.words(line)
            ends.append(len(whole))
        most = 0.0
        for j, size in enumerate(m.sizes):
            for a, b in [*zip(ends, ends[1:], strict=False), *((i, i + size) for i in range(len(whole) - size + 1))]:
                score = m.cosine_of(j, whole[a:b])
                if score > most and m.allowed(j, whole, a, b):
                    most = score
        got = m.scan(text)
        assert abs(got[1] - most) < 1e-6 if most >= m.cosine else got[0] is None


def test_frequencies_of_all_words(spark):
    texts = ["a b. B c2", "b\nd", None, "", "B-b"]
    df, n = license_scan.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text")
    assert (df, n) == ({"a": 1, "b": 3, "c": 1, "2": 1, "d": 1}, 5)
