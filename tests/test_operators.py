"""Operators against golden sets and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from alignscope import model
from alignscope.functions import codec
from alignscope.operators import geometry, labels, quantiles, rotation, score, tally
from alignscope.plans import registry
from alignscope.sources import raw, tensors

#: Discs against half planes, unit, label and shared pixels; -1 stands for a marginal.
GOLDEN = [
    (7, -1, 100), (-1, 0, 90), (-1, 1, 70), (-1, 2, 50), (-1, 3, 30), (-1, 4, 10), (7, 0, 90), (7, 1, 70), (7, 2, 50), (7, 3, 30), (7, 4, 10), (0, -1, 1), (1, -1, 6), (2, -1, 17), (3, -1, 35), (4, -1, 58), (5, -1, 88), (6, -1, 97),
    (6, 0, 87), (5, 0, 78), (6, 1, 67), (5, 1, 58), (4, 0, 49), (6, 2, 47), (5, 2, 38), (4, 1, 33), (3, 0, 28), (6, 3, 27), (5, 3, 20), (4, 2, 18), (3, 1, 16), (2, 0, 12), (6, 4, 8), (4, 3, 5), (3, 2, 5), (5, 4, 5),
]
DISCS = [1, 6, 17, 35, 58, 88, 97, 100]


def test_golden_tally(spark):
    got = registry.queries()["golden_tally"](spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(GOLDEN)


def test_golden_self_tally(spark):
    grid = spark.range(100).selectExpr("cast(id / 10 as int) y", "cast(id % 10 as int) x", "0L image", "explode(sequence(0, 7)) unit").where("x * x + y * y <= 4 * unit * unit")
    both = grid.unionByName(grid.where("unit < 3").withColumn("image", grid["image"] + 1))
    got = {(r["image"], r["u1"], r["u2"]): r["n"] for r in tally.self_tally(both).collect()}
    assert got == {(0, a, b): DISCS[a] for a in range(8) for b in range(a, 8)} | {(1, a, b): DISCS[a] for a in range(3) for b in range(a, 3)}


def test_tally_against_numpy(spark):
    rng = np.random.default_rng(3)
    masks, marks = rng.random((5, 3, 4, 4)) < 0.3, rng.integers(0, 4, (5, 2, 4, 4))
    m = spark.createDataFrame([(int(i), int(u), int(y), int(x)) for i, u, y, x in np.argwhere(masks)], model.MASKS)
    p = spark.createDataFrame([(int(i), "c", int(k), int(y), int(x), int(marks[i, k, y, x])) for i in range(5) for k in range(2) for y in range(4) for x in range(4)], model.PIXEL_LABELS)
    got = {(r["image"], r["unit"], r["label"]): r["n"] for r in tally.tally(m, p).collect()}
    want = {}
    for i in range(5):
        for u in range(3):
            want[i, u, -1] = int(masks[i, u].sum())
            for k in range(1, 4):
                want[i, -1, k] = int((marks[i] == k).sum())
                want[i, u, k] = int(((marks[i] == k) & masks[i, u]).sum())
    assert got == {k: n for k, n in want.items() if n}


def test_scores_are_shares(spark):
    for r in registry.queries()["agg_iou"](spark, "/root/testdata/sf0.001").collect():
        assert 0 <= r["iou"] <= 1 and r["intersect"] <= min(r["truth"], r["activation"])


def test_ties(spark):
    rows = spark.createDataFrame([(0, "a", 2, 0.5), (0, "a", 1, 0.5), (0, "b", 3, 0.5), (1, "a", 1, 0.0)], "unit int, category string, label int, iou double")
    best = score.best_label(rows)
    assert {(r["unit"], r["category"], r["label"]) for r in best.collect()} == {(0, "a", 1), (0, "b", 3), (1, "a", 1)}
    assert {(r["unit"], r["category"]) for r in score.best_category(best).collect()} == {(0, "b"), (1, "a")}


def test_quantiles_ignore_what_is_no_number(spark):
    rows = spark.createDataFrame([(0, float("nan")), (0, 1.0), (0, None), (0, 3.0), (1, None)], "unit int, value double")
    got = {r["unit"]: (r["min_value"], r["max_value"]) for r in quantiles.extremes(rows).collect()}
    assert got == {0: (1.0, 3.0), 1: (None, None)}


def test_sketch_is_close(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=20000)
    rows = spark.createDataFrame([(0, float(x)) for x in v], "unit int, value double")
    t = quantiles.sketch_thresholds(rows).first()["threshold"]
    assert abs((v > t).mean() - 0.005) < 0.0015


def test_large_groups_are_sketched(spark):
    v = np.random.default_rng(1).normal(size=9000)
    rows = spark.createDataFrame([(0, float(x)) for x in v], "unit int, value double")
    exact, sketched = (quantiles.bounded_thresholds(rows, exact_upto=n).first()["threshold"] for n in (9000, 8999))
    assert exact == quantiles.thresholds(rows).first()["threshold"] and abs((v > sketched).mean() - 0.005) < 0.001


def test_threshold_numbers():
    assert model.threshold_index() == 5 and model.quantile_code(0.005) == "005" and model.decode_quantile("005") == 0.005
    assert tensors.latest(["a1", "a12", "a3"]) == "a12" and tensors.latest([]) is None


def test_upsampling_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.random((2, 4, 4))
    rows = spark.createDataFrame([(i, 0, y, x, float(v[i, y, x])) for i in range(2) for y in range(4) for x in range(4)], model.ACTIVATIONS)
    got = np.zeros((2, 16, 16))
    for r in geometry.upsample(rows, 4, 16, 2, 4).collect():
        got[r["image"], r["y"], r["x"]] = r["value"]
    at = np.clip((np.arange(16) - 2) / 4, 0, 3)
    rowwise = np.array([[np.interp(at, range(4), v[i, y]) for y in range(4)] for i in range(2)])
    want = np.array([[np.interp(at, range(4), rowwise[i, :, x]) for x in range(16)] for i in range(2)]).transpose(0, 2, 1)
    assert np.allclose(got, want)


def maps_of(spark, v):
    return spark.createDataFrame([(i, 0, y, x, float(v[i, y, x])) for i, y, x in np.ndindex(*v.shape)], model.ACTIVATIONS)


def array_of(rows, n, pixels):
    got = np.zeros((n, pixels, pixels))
    for r in rows.collect():
        got[r["image"], r["y"], r["x"]] = r["value"]
    return got


@pytest.mark.parametrize("cells", [2, 3, 4, 5, 9])
def test_cubic(cells):
    """The spline meets its cells, gives back polynomials up to its degree, and bends smoothly over the last inner cells."""
    assert np.allclose(geometry.cubic_weights(cells, cells, 0, 1), np.eye(cells))
    at = np.clip((np.arange(40) - 3) / 4, 0, cells - 1)
    w = geometry.cubic_weights(cells, 40, 3, 4)
    for degree in range(min(cells, 4)):
        assert np.allclose(w @ np.arange(cells) ** degree, at**degree)
    if cells > 4:
        fine = geometry.cubic_weights(cells, 3 * 1000, 0, 1000) @ np.random.default_rng(1).random(cells)
        third = np.diff(fine, 3) * 1e9
        assert abs(third[500] - third[1500]) < 0.05 * max(1, abs(third[500]))  # no knot at the second cell


def test_gauss(spark):
    """Against a plain convolution over all pixels, zero outside."""
    v = np.random.default_rng(4).normal(size=(2, 4, 4))
    field, sigma, reach = geometry.Field(-1, 5, 3), 2.0, 8
    wide = np.zeros((2, 12, 12))
    at = 1 + 3 * np.arange(4)
    wide[:, at[:, None], at[None, :]] = v * 9
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    want = np.zeros_like(wide)
    for y, x in np.ndindex(12, 12):
        for b, c in np.ndindex(12, 12):
            if abs(y - b) <= reach and abs(x - c) <= reach:
                want[:, y, x] += wide[:, b, c] * kernel[y - b + reach] * kernel[x - c + reach]
    assert np.allclose(array_of(geometry.resample(maps_of(spark, v), *[geometry.gauss_weights(4, 12, 1, 3, sigma, 3)] * 2), 2, 12), want)
    assert np.allclose(array_of(geometry.upsample_gauss(maps_of(spark, v), 4, 12, field), 2, 12), want)
    masks = {(r["image"], r["y"], r["x"]) for r in geometry.mask_set(maps_of(spark, v), 4, 12, geometry.Field(-1, 20, 3), sigma=0.1).collect()}
    soft = want_of(v, 20 // 2 - 1)
    assert masks == {tuple(map(int, k)) for k in np.argwhere(soft > 0.5 * soft.max())}


def want_of(v, center, sigma=2.0, reach=8, pixels=12):
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    w = np.array([[kernel[p - q + reach] if abs(p - q) <= reach and q < pixels else 0.0 for q in center + 3 * np.arange(4)] for p in range(pixels)])
    return w @ v @ w.T


def test_unpermuted():
    r = rotation.near_identity(7, 0.05, 2)
    for seed in range(5):
        assert np.allclose(rotation.unpermuted(np.random.default_rng(seed).permutation(r)), r)


def test_numbered(spark):
    from alignscope.shared import numbered

    rows = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)], "k int, s string").repartition(5)
    assert [(r["k"], r["at"]) for r in numbered(rows, "at", "k").orderBy("k").collect()] == [(k, k + 1) for k in range(1000)]
    assert numbered(rows.limit(0), "at", "k").count() == 0


def test_large_tables_are_not_sent(spark, monkeypatch):
    from alignscope import shared

    rows, few = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in rows.join(shared.sent(few), "k")._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(shared, "BROADCAST_BYTES", 10_000)
        assert "BroadcastHashJoin" in rows.join(shared.sent(few), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_category(spark):
    best = spark.createDataFrame([(0, "a", 2, 0.5)], "unit int, category string, label int, iou double")
    got = score.every_category(best, spark.createDataFrame([(0,), (1,)], "unit int"), ["a", "b"]).collect()
    assert {(r["unit"], r["category"], r["label"], r["iou"]) for r in got} == {(0, "a", 2, 0.5), (0, "b", None, 0.0), (1, "a", None, 0.0), (1, "b", None, 0.0)}


def test_labels_of_whole_images(spark):
    pixels = spark.createDataFrame([(1, "d", "c", "x"), (1, "d", "c", "x"), (1, "d", "c", "y"), (2, "d", "c", "x")], "image int, dataset string, category string, label string")
    sizes = spark.createDataFrame([(1, 4), (2, 4)], "image int, pixels int")
    whole = spark.createDataFrame([(1, "d", "scene", "x"), (1, "d", "scene", "x"), (2, "d", "c", "y")], "image int, dataset string, category string, label string")
    want = {("c", "x"): (2, 0.75), ("c", "y"): (2, 1.25), ("scene", "x"): (1, 1.0)}
    for rows, size in ((pixels, sizes), (pixels.join(sizes, "image"), None)):
        got = labels.label_statistics(rows, size, whole).collect()
        assert {(r["category"], r["label"]): (r["frequency"], r["coverage"]) for r in got} == want


def test_layers():
    edges = [("a", "b"), ("b", "c"), ("a", "c")]
    assert geometry.topological(edges) == ["a", "b", "c"] and geometry.shortest_path(edges, "a", "c") == ["a", "c"]
    with pytest.raises(ValueError, match="cycle"):
        geometry.topological([("a", "b"), ("b", "a")])


def test_rotations():
    r = rotation.random_rotation(6, 1)
    assert np.allclose(r @ r.T, np.eye(6)) and np.isclose(np.linalg.det(r), 1)
    half = rotation.power(r, 0.5)
    assert np.allclose(half @ half, r) and rotation.deviation(np.eye(6)) == 0


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 1000))
def test_label_pictures(h, w, seed):
    m = np.random.default_rng(seed).integers(0, 65536, (h, w))
    assert (codec.decode_labels(codec.encode_labels(m)) == m).all()


def test_names():
    got = labels.resolve_names([("x", ["cat", "kitty"], 10, 5.0), ("y", ["kitty"], 4, 2.0), ("z", ["dog"], 3, 1.0), ("w", [], 1, 1.0)])
    assert got == {"x": "cat", "y": "cat", "z": "dog"}


def test_part_key_and_index():
    text = "pimap{15}('head') = 1;\nfor ii = 1:2\n pimap{2}(sprintf('wheel_%d', ii)) = 9 + ii;\nend"
    assert raw.read_part_key(text) == {15: {"head": 1}, 2: {"wheel_1": 10, "wheel_2": 11}}
    assert raw.read_index_names("1: tree\n2: big house\n") == {1: "tree", 2: "big house"}
    assert (raw.paint([(1, np.ones((2, 2))), (2, np.eye(2))], (2, 2)) == [[2, 1], [1, 2]]).all()


def test_flat_tensor(spark, tmp_path):
    v = np.arange(2 * 3 * 2 * 2, dtype="<f4")
    v.tofile(tmp_path / "a.mmap")
    rows = tensors.read_flat(spark, str(tmp_path), (None, 3, 2, 2)).orderBy("image", "unit", "y", "x").collect()
    assert [r["value"] for r in rows] == v.tolist() and rows[-1]["image"] == 1


def test_matlab_file():
    import struct
    import zlib

    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    numbers = np.array([[1.0, 2.0], [3.0, 4.0]])
    m = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 2, 2)) + element(1, b"a") + element(9, numbers.T.tobytes())
    packed = zlib.compress(element(14, m))
    data = b" " * 124 + b"\x00\x01IM" + struct.pack("<II", 15, len(packed)) + packed
    assert (raw.read_mat(data)["a"] == numbers).all()


def test_splits():
    with pytest.raises(ValueError, match="sum"):
        labels.split_of(None, [("a", 0.5), ("b", 0.4)])


def test_called_names_against_fold(spark):
    from random import Random

    rng = Random(4)
    rows = [(f"k{k}", [f"n{rng.randint(0, 25)}" for _ in range(rng.randint(0, 4))], rng.randint(0, 6), rng.randint(0, 8) / 4) for k in range(120)]
    got = {r["key"]: r["name"] for r in labels.called_names(spark.createDataFrame(rows, "key string, names array<string>, frequency long, coverage double")).collect()}
    assert got == labels.resolve_names(rows)


def test_unify_query_against_brute_force(spark, tmp_path):
    """Words in as few documents as the rule of the vocabulary allows are numbered."""
    from collections import Counter
    from fractions import Fraction

    from alignscope.plans import registry

    docs = [(i, " ".join(w for k, w in enumerate(("all", "Half", "ten", "nine", "thin", "more")) if i % 60 < (60, 30, 10, 9, 12, 45)[k] for _ in range(1 if w == "thin" else 8)) + (" pad" * 60 if i >= 48 else ""), "en" if i % 2 else "de", "s") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    frequency, coverage = Counter(), Counter()
    for _, text, _, _ in docs:
        words = text.lower().split()
        for w, c in Counter(words).items():
            frequency[w] += 1
            coverage[w] += Fraction(c, len(words))
    kept = sorted((w for w in frequency if frequency[w] >= 10 and coverage[w] >= Fraction(1, 2)), key=lambda w: (-frequency[w], -coverage[w], w))
    assert {"ten", "pad"} < set(kept) and not {"nine", "thin"} & set(kept)
    got = sorted(tuple(r) for r in registry.queries()["pipeline_unify"](spark, str(tmp_path)).collect())
    assert got == [(n + 1, w, frequency[w], round(float(coverage[w]), 6)) for n, w in enumerate(kept)]


def test_numbers_ignore_last_bits(spark):
    """Sums that differ in their last bits, as the order of rows makes them, are a tie, which goes by name."""
    stats = spark.createDataFrame([("c", "b", 12, 0.1 + 0.2 + 0.3), ("c", "a", 12, 0.3 + 0.2 + 0.1), ("c", "d", 12, 0.600001)], "category string, label string, frequency long, coverage double")
    for numbers in (labels.number_labels(stats).select("number", "label"), labels.dense_codes(stats).select("code", "label")):
        assert sorted(map(tuple, numbers.collect())) == [(1, "d"), (2, "a"), (3, "b")]


def test_unify_query_against_sql(spark, tmp_path):
    """Coverages that agree to six digits, words without a language, white space and capitals that SQL takes otherwise."""
    import duckdb

    both = [(i, "z a" + " pad" * 8, "en", "s") for i in range(10)]
    # a covers 1/97 + 1/112 more, z 1/102 + 1/106, which is more by 3e-8
    near = [(10 + i, w + " pad" * (n - 1), "en", "s") for i, (w, n) in enumerate((("a", 97), ("a", 112), ("z", 102), ("z", 106)))]
    other = [(20 + i, "one\x0btwo three\fthree ΟΔΟΣ İz - Été", None if i % 2 else "de", None if i % 3 else "s") for i in range(24)]
    spark.createDataFrame([*both, *near, *other, (50, None, "en", "s"), (51, " ", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(c.execute(registry.oracle_sql()["pipeline_unify"]).fetchall())
    assert [w for _, w, _, _ in want] == ["three", "iz", "one\x0btwo", "été", "οδοσ", "pad", "a", "z"]
    assert sorted(map(tuple, registry.queries()["pipeline_unify"](spark, str(tmp_path)).collect())) == want
