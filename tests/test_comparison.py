"""Comparisons that have no SQL, against numpy; statistics against exact values."""

import math

import numpy as np
import pytest

from ensemblespark.functions import power
from ensemblespark.operators import catalogs as C
from ensemblespark.operators import ensembles as E
from ensemblespark.plans import registry


@pytest.fixture(scope="module")
def ensembles(spark):
    """Two ensembles of 300 and 40 frames of five points, turned at random."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 3)) * 5
    out = {}
    for e, n in ((0, 300), (1, 40)):
        turn = np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))[:, None, None]
        out[e] = np.einsum("fij,faj->fai", turn, base + rng.normal(size=(n, 5, 3)) * (0.3 + e)) + rng.normal(size=(n, 1, 3))
    rows = [(e, f, r, *map(float, x[f, r])) for e, x in out.items() for f in range(len(x)) for r in range(5)]
    return out, base, spark.createDataFrame(rows, "ensemble_id long, frame_idx int, res_idx int, x double, y double, z double").repartition(6)


def test_superposition(spark, ensembles):
    x, base, frames = ensembles
    got = E.superposed(E.flat(frames), base.ravel().tolist()).collect()
    assert len(got) == 340 and all(r.det == pytest.approx(1) for r in got)
    for r in got[:60]:
        p, q = x[r.ensemble_id][r.frame_idx], base
        a, b = p - p.mean(0), q - q.mean(0)
        s = np.linalg.svd(a.T @ b, compute_uv=False)
        s[2] *= np.sign(np.linalg.det(a.T @ b))
        least = math.sqrt(max(0, (a**2).sum() + (b**2).sum() - 2 * s.sum()) / 5)
        assert r.rmsd == pytest.approx(least, abs=1e-9)
    mirrored = spark.createDataFrame([(0, 0, (base * [1, 1, -1]).ravel().tolist())], "ensemble_id long, frame_idx int, v array<double>")
    one = E.superposed(mirrored, base.ravel().tolist()).first()
    assert one.det == pytest.approx(1) and one.rmsd > 0.1


def test_distances_over_blocks(ensembles):
    from pyspark.sql import functions as F

    x, _, frames = ensembles
    rows = E.flat(frames).withColumn("label", (F.col("frame_idx") % 2).cast("string"))
    got = {(r.ensemble_id, r.frame_idx, r.label): (r.total, r.n) for r in E.frame_distances(rows).collect()}
    for e, v in x.items():
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum((2, 3)) / 5)
        for f in range(0, len(v), 17):
            for k in (0, 1):
                assert got[e, f, str(k)] == (pytest.approx(d[f, k::2].sum()), len(v[k::2]))


def test_gaussian_distances_and_axes(ensembles):
    x, _, frames = ensembles
    c = E.covariance(frames)
    got = {r.res_idx: r for r in E.gaussian_w2(c.where("ensemble_id = 1"), c.where("ensemble_id = 0")).collect()}
    for r in range(5):
        s1, s2 = (np.cov(x[e][:, r].T, bias=True) for e in (0, 1))
        w = np.linalg.eigvals(s1 @ s2).real
        want = math.sqrt(np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.clip(w, 0, None)).sum())
        assert got[r].variance == pytest.approx(want, abs=1e-6) and got[r].translation == pytest.approx(np.linalg.norm(x[0][:, r].mean(0) - x[1][:, r].mean(0)))
    axes = {(r.ensemble_id, r.axis): r for r in E.principal_axes(frames).collect()}
    for e in (0, 1):
        w, v = np.linalg.eigh(np.cov(x[e].reshape(len(x[e]), -1).T, bias=True))
        for k in range(3):
            assert axes[e, k].variance == pytest.approx(w[-1 - k]) and abs(np.dot(axes[e, k].direction, v[:, -1 - k])) == pytest.approx(1)


def test_rmwd_is_made_of_its_parts(spark):
    at = "/root/testdata/sf0.001"
    parts = registry.QUERIES["gaussian_w2"](spark, at).toPandas().groupby("ensemble_id")
    for r in registry.QUERIES["rmwd"](spark, at).collect():
        g = parts.get_group(r.ensemble_id)
        assert (r.translation, r.variance) == (pytest.approx(math.sqrt((g.translation**2).mean()), abs=1e-5), pytest.approx(math.sqrt((g.variance**2).mean()), abs=1e-5))
        assert r.rmwd == pytest.approx(math.hypot(r.translation, r.variance), abs=1e-5)
    assert {r.ensemble_id for r in registry.QUERIES["pc1_cosine"](spark, at).where("cosine between 0 and 1").collect()} == set(parts.groups)


def test_t_values_and_detectable_effects():
    assert [power.t_critical(k) for k in (1, 4, 24)] == pytest.approx([12.7062, 2.77645, 2.06390], abs=2e-3)
    assert [power.detectable(n) for n in (5, 10, 15)] == pytest.approx([1.68, 1.00, 0.78], abs=0.01)


def test_replacements_end_or_go_round(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("p", "x")] + [(f"n{i}", f"n{i + 1}") for i in range(40)]
    got = {r.old: r.leaf for r in C.resolve(spark.createDataFrame(pairs, "old string, new string")).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", **{f"n{i}": "n40" for i in range(40)}}
    assert C.resolve(spark.createDataFrame([], "old string, new string")).collect() == []


def test_worst_members_go_only_if_that_helps(spark):
    rows = [(1, i, d) for i, d in enumerate([1.0, 2.0, 9.0])] + [(2, i, d) for i, d in enumerate([1.0, 8.0, 9.0, 9.5])] + [(3, i, d) for i, d in enumerate([1.0, 2.0, 9.0, 9.0])] + [(4, 0, 9.0), (4, 1, 1.0)]
    left = C.drop_outliers(spark.createDataFrame(rows, "c int, i int, d double"), "c", "i", "d", 3.5, 2, 2).collect()
    assert sorted((r.c, r.i) for r in left) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1), (4, 0), (4, 1)]


def test_profile_of_members_is_counted_before_it_is_shuffled(spark, monkeypatch):
    from collections import Counter

    from ensemblespark.operators import alignments as A

    monkeypatch.setattr(A, "LETTERS", 5)
    monkeypatch.setattr(A, "PART", 2)
    rows = [("c", i, s) for i, s in enumerate(["abc", "abd", "", None, "é🙂-", "a", "abcdefghijkl", "ab", "xbc"])] + [("d", 0, "aa"), (None, 0, "a")]
    near = [("c", i, 0 if i % 3 else 1) for i in range(9)] + [("d", 0, 0), (None, 0, 0)]
    msa, assigned = spark.createDataFrame(rows, "chain string, row_idx int, seq string"), spark.createDataFrame(near, "chain string, row_idx int, center int")
    of = {(c, i): s for c, i, s in rows}
    members = Counter((c, m) for c, _, m in near)
    cells = Counter((c, m, col, x) for c, i, m in near if c for col, x in enumerate(of[c, i] or ""))
    got = A.cluster_profile(msa, assigned)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {(r.chain, r.center, r.col, r.letter): (r.share, r.members) for r in got.collect()} == {k: (n / members[k[:2]], members[k[:2]]) for k, n in cells.items()}
    assert "Generate" not in plan and plan.count("ExistingRDD") <= 1  # no row a letter; the assignment isn't made twice
