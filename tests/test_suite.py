"""The evaluation suite, its floor, time-lagged components and assignments, against numpy."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from ensemblespark.operators import ensembles as E
from ensemblespark.operators import suite as S

LAG, DRAWS, THIN = 3, 60, 40


def number(seed, *parts):
    return int(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:12], 16)


@pytest.fixture(scope="module")
def ensembles(spark):
    """Four ensembles of moving chains of eight points, each frame turned at random; e0 is the reference."""
    rng = np.random.default_rng(11)
    base = np.cumsum(rng.normal(size=(8, 3)) * 1.2 + [2.8, 0, 0], axis=0)
    mode = rng.normal(size=(8, 3))
    out = {}
    for e, n in (("e0", 75), ("e1", 20), ("e2", 31), ("e3", 20)):
        slow = np.cumsum(rng.normal(size=n)) * 0.5
        x = base + slow[:, None, None] * mode + rng.normal(size=(n, 8, 3)) * (0.4 + 0.1 * int(e[1]))
        turn = np.linalg.qr(rng.normal(size=(n, 3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))[:, None, None]
        out[e] = np.einsum("fij,faj->fai", turn, x) + rng.normal(size=(n, 1, 3))
    rows = [(e, f, v[f].ravel().tolist()) for e, v in out.items() for f in range(len(v))]
    segments = [(e, f, f // 25) for e, v in out.items() for f in range(len(v))]
    return out, spark.createDataFrame(rows, "ensemble_id string, frame_idx long, v array<double>").repartition(5), spark.createDataFrame(segments, "ensemble_id string, frame_idx long, segment long")


def onto(x, target):
    out = []
    for f in x:
        a, b = f - f.mean(0), target - target.mean(0)
        u, _, vt = np.linalg.svd(a.T @ b)
        d = np.sign(np.linalg.det(u @ vt))
        out.append(a @ (u @ np.diag([1, 1, d]) @ vt) + target.mean(0))
    return np.array(out)


def spread(a, b):
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum((2, 3)) / a.shape[1]).mean()


def fluctuation(x):
    return np.sqrt(((x - x.mean(0)) ** 2).sum(2).mean(0))


def axes(x, k=2):
    flat = x.reshape(len(x), -1)
    _, s, vt = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    return vt[:k], s**2 / len(x)


def least_cost(p, q):
    """Exact assignment by the Hungarian method over dictionaries: small and slow."""
    n = len(p)
    cost = ((p[:, None] - q[None]) ** 2).sum(2)
    u, v, row, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row[0], j0 = i, 0
        least, used = [math.inf] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row[j0], math.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[row[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if row[j0] == 0:
                break
        while j0:
            row[j0] = row[way[j0]]
            j0 = way[j0]
    return sum(cost[row[j] - 1][j - 1] for j in range(1, n + 1))


def pair_d(x, sep):
    i, j = np.triu_indices(x.shape[1], sep)
    return np.sqrt(((x[:, i] - x[:, j]) ** 2).sum(2))


def histogram_js(ref, gen, bins=50):
    js, hit = [], []
    for r, g in zip(ref.T, gen.T, strict=True):
        lo, hi = r.min(), r.max()
        if hi <= lo:
            lo, hi = lo - 0.5, hi + 0.5
        at = lambda x: np.where((np.floor((x - lo) / ((hi - lo) / bins)) == bins) & (x <= hi), bins - 1, np.floor((x - lo) / ((hi - lo) / bins)))  # noqa: B023, E731
        count = lambda k: np.array([(k == b).sum() for b in range(bins)]) + 1e-6
        p, q = count(at(r)), count(at(g))
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        js.append(math.sqrt(max(0, ((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()) / 2)))
        hit.append(((at(g) >= 0) & (at(g) < bins)).mean())
    return np.mean(js), np.mean(hit)


def lagged(x, segments, lag, dim=2):
    m = x.mean(0)
    c0 = (x - m).T @ (x - m) / len(x)
    pairs = [(a, a + lag) for a in range(len(x) - lag) if segments[a] == segments[a + lag]]
    a, b = (np.array([x[p[k]] for p in pairs]) - m for k in (0, 1))
    c1 = (a.T @ b + b.T @ a) / (2 * len(pairs))
    w, v = np.linalg.eigh(c0)
    white = v[:, w > 1e-10 * w.max()] / np.sqrt(w[w > 1e-10 * w.max()])
    values, vectors = np.linalg.eigh(white.T @ c1 @ white)
    order = np.argsort(-values)[:dim]
    return values[order], m, white @ vectors[:, order]


def information(on):
    n, size = on.shape
    out = np.zeros((size, size))
    for i, j in itertools.product(range(size), repeat=2):
        if i != j:
            for x, y in itertools.product((0, 1), repeat=2):
                p = ((on[:, i] == x) & (on[:, j] == y)).mean()
                if p > 0:
                    out[i, j] += p * math.log(p / ((on[:, i] == x).mean() * (on[:, j] == y).mean()))
    return out


def ranks(x):
    return np.array([((x < v).sum() + ((x <= v).sum() + 1)) / 2 for v in x])


def plain_suite(gen, ref, segments, pool, seed, on_gen=None, on_ref=None):
    crystal, k = ref[0], len(gen)
    draw = {r: [number(seed, pool, r, d) % len(ref) for d in range(n)] for r, n in (("rand1", k), ("rand2", k), ("rand1k", DRAWS))}
    gen, ref = onto(gen, crystal), onto(ref, crystal)
    one, two, many = (ref[draw[r]] for r in ("rand1", "rand2", "rand1k"))
    out = {"n_gen": k, "n_ref": len(ref), "n_ca": gen.shape[1]}
    own = spread(gen, gen)
    out |= {"pairwise_rmsd_gen": own, "pairwise_rmsd_gen_debiased": own * k / (k - 1), "pairwise_rmsd_ref": spread(one, two), "pairwise_rmsd_abs_error": abs(own - spread(one, two))}
    g, r = fluctuation(gen), fluctuation(ref)
    out |= {"rmsf_median_gen": np.median(g), "rmsf_median_ref": np.median(r), "rmsf_mean_gen": g.mean(), "rmsf_mean_ref": r.mean(), "rmsf_r": np.corrcoef(g, r)[0, 1]}
    t, v = [], []
    for a in range(gen.shape[1]):
        s1, s2 = np.cov(many[:, a].T, bias=True), np.cov(gen[:, a].T, bias=True)
        w, u = np.linalg.eigh(s1)
        root = (u * np.sqrt(np.maximum(w, 0))) @ u.T
        t.append(np.linalg.norm(many[:, a].mean(0) - gen[:, a].mean(0)))
        v.append(math.sqrt(max(0, np.trace(s1) + np.trace(s2) - 2 * np.sqrt(np.maximum(np.linalg.eigvalsh(root @ s2 @ root), 0)).sum())))
    t, v = math.sqrt(np.mean(np.square(t))), math.sqrt(np.mean(np.square(v)))
    out |= {"rmwd": math.hypot(t, v), "rmwd_translation": t, "rmwd_variance": v}
    flat = lambda x: x.reshape(len(x), -1)
    for name, (basis, _) in (("md_pca_w2", axes(ref)), ("joint_pca_w2", axes(np.concatenate([one, gen])))):
        out[name] = math.sqrt(least_cost(flat(one) @ basis.T, flat(gen) @ basis.T) / k / gen.shape[1])
    out["pc1_cosine"] = abs(axes(ref)[0][0] @ axes(gen)[0][0])
    i, j = np.triu_indices(gen.shape[1], 1)
    native = pair_d(crystal[None], 1)[0] < 8
    p, q = (pair_d(one, 1) < 8).mean(0), (pair_d(gen, 1) < 8).mean(0)
    jaccard = lambda a, b: (a & b).sum() / (a | b).sum() if (a | b).any() else None
    out["weak_contact_jaccard"] = jaccard(native & (p < 0.9), native & (q < 0.9))
    out["transient_contact_jaccard"] = jaccard(~native & (p > 0.1), ~native & (q > 0.1))
    for name, x in (("gen", gen), ("ref", one)):
        d = pair_d(x, 1)[:, j == i + 1]
        out[f"ca_bond_violation_fraction_{name}"] = ((d < 3.5) | (d > 4.2)).mean()
        out[f"clash_fraction_{name}"] = (pair_d(x, 3) < 3.5).mean()
        s = axes(x)[1]
        out[f"n_eff_{name}"] = s.sum() ** 2 / (s**2).sum()
    out |= {"diversity_ratio": own / spread(one, one), "mean_pairwise_rmsd_gen": own, "mean_pairwise_rmsd_ref": spread(one, one), "rmsf_mean_ratio": g.mean() / fluctuation(one).mean()}
    step = math.ceil(len(ref) / THIN)
    at = [a for s in sorted(set(segments)) for a in [b for b in range(len(ref)) if segments[b] == s][::step]]
    thin, of = ref[at], [segments[a] for a in at]
    out["js_pwd"], out["js_pwd_hit_fraction"] = histogram_js(pair_d(thin, 3), pair_d(gen, 3))
    gyration = lambda x: np.sqrt(((x - x.mean(1, keepdims=True)) ** 2).sum(2).mean(1))[:, None]
    out["js_rg"], out["js_rg_hit_fraction"] = histogram_js(gyration(thin), gyration(gen))
    _, m, basis = lagged(pair_d(thin, 1), of, LAG)
    out["js_tic"], out["js_tic_hit_fraction"] = histogram_js((pair_d(thin, 1) - m) @ basis, (pair_d(gen, 1) - m) @ basis)
    out["exposed_residue_jaccard"] = out["exposure_mi_rho"] = None
    if on_gen is not None:
        buried, often = ~on_ref[0], lambda x: x.mean(0) > 0.1
        sample = on_ref[draw["rand1k"]]
        out["exposed_residue_jaccard"] = jaccard(often(on_gen) & buried, often(sample) & buried)
        a, b = (ranks(np.round(information(x), 12).ravel()) for x in (on_gen, sample))
        out["exposure_mi_rho"] = np.corrcoef(a, b)[0, 1]
    return out


def same(got, want):
    assert set(got) == set(want)
    for name, value in want.items():
        if value is None:
            assert got[name] is None, name
        else:
            assert got[name] == pytest.approx(value, abs=2e-6), name


def test_suite_equals_plain_version(spark, ensembles):
    x, rows, segments = ensembles
    pairs = spark.createDataFrame([(f"a-{e}", e, "e0") for e in ("e1", "e2", "e3")], "case string, gen string, ref string")
    on = {e: np.random.default_rng(9).random((len(v), 8)) < np.linspace(0, 0.6, 8) for e, v in x.items()}
    exposure = spark.createDataFrame([(e, f, r, bool(v[f, r])) for e, v in on.items() for f in range(len(v)) for r in range(8)], "ensemble_id string, frame_idx long, res_idx int, on boolean")
    got = {}
    for r in S.ensemble_suite(rows, pairs, segments, LAG, DRAWS, THIN, exposure=exposure).collect():
        assert got.setdefault(r.case, {}).setdefault(r.metric, r.value) == r.value
    assert set(got) == {"a-e1", "a-e2", "a-e3"}
    for e in ("e1", "e2", "e3"):
        same(got[f"a-{e}"], plain_suite(x[e], x["e0"], [f // 25 for f in range(75)], "e0", S.SEED, on[e], on["e0"]))
    with pytest.raises(ValueError, match="some have none"):
        S.ensemble_suite(rows, pairs, segments, LAG, DRAWS, THIN, exposure=exposure.where("frame_idx > 0"))


def test_floor_equals_plain_version(spark, ensembles):
    x, rows, segments = ensembles
    got, refused = {}, {}
    for r in S.reference_floor(rows.where("ensemble_id in ('e0', 'e1')"), segments.where("ensemble_id in ('e0', 'e1')"), 15, 3, LAG, DRAWS, THIN).collect():
        if r.violation:
            refused[r.ensemble_id] = r.violation
        else:
            got[r.metric] = r
    assert refused == {"e1": "held-out half has 10 frames, fewer than 15"}
    early = [f for f in range(75) if f % 25 < 12]
    late = [f for f in range(75) if f % 25 >= 12]
    draws = []
    for d in range(3):
        picked = sorted(sorted(late, key=lambda f: (number(S.SEED + d, "e0", "held", f), f))[:15])  # noqa: B023
        draws.append(plain_suite(x["e0"][picked], x["e0"][early], [f // 25 for f in early], "e0", S.SEED + d))
    assert set(got) == set(draws[0])
    for name in got:
        values = [d[name] for d in draws if d[name] is not None]
        assert got[name].n == len(values)
        if values:
            assert got[name].mean == pytest.approx(np.mean(values), abs=2e-6), name
            assert got[name].sd == pytest.approx(np.std(values, ddof=1) if len(values) > 1 else 0.0, abs=5e-6), name


def test_short_segments_are_refused(spark, ensembles):
    _, rows, segments = ensembles
    one = segments.where("ensemble_id = 'e3'").selectExpr("ensemble_id", "frame_idx", "case when frame_idx = 5 then 9 else 0 end as segment")
    assert [r.violation for r in S.reference_floor(rows.where("ensemble_id = 'e3'"), one, 5, 2, LAG, DRAWS, THIN).collect()] == ["segment of 1 frames cannot be halved"]


def test_tica_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for name, lengths in (("a", [60, 40, 7]), ("b", [30]), ("none", [4, 5])):
        n = sum(lengths)
        x = np.cumsum(rng.normal(size=(n, 4)), 0) @ rng.normal(size=(4, 6)) + 50  # of rank 4
        segments = np.repeat(np.arange(len(lengths)), lengths)
        place = np.concatenate([np.arange(k) for k in lengths])
        rows += [(name, int(s), int(p), v.tolist()) for s, p, v in zip(segments, place, x, strict=True)]
        if name != "none":
            want[name] = (x, segments.tolist())
    df = spark.createDataFrame(rows, "sample string, segment long, place long, f array<double>").repartition(7)
    got = {}
    for r in S.tica(df, lag=6, dim=3).collect():
        got.setdefault(r.sample, {})[r.axis] = r
    assert set(got) == {"a", "b"}
    for name, (x, segments) in want.items():
        values, m, basis = lagged(x, segments, 6, 3)
        for k in range(3):
            r = got[name][k]
            assert r.eigenvalue == pytest.approx(values[k], abs=1e-7)
            assert r.mean == pytest.approx(m.tolist())
            a, b = (x - m) @ np.array(r.basis), (x - m) @ basis[:, k]
            assert abs(a @ b) == pytest.approx(np.linalg.norm(a) * np.linalg.norm(b), rel=1e-6)


def test_assignment_is_the_best_of_all(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for n in range(1, 8):
        for t in range(4):
            p, q = (np.round(rng.normal(size=(n, 2)), 1 + t % 2) for _ in range(2))
            best = min(sum(((p[i] - q[k]) ** 2).sum() for i, k in enumerate(perm)) for perm in itertools.permutations(range(n)))
            for name, one, two in ((f"{n}-{t}", p, q), (f"{n}-{t}-back", q, p)):
                want[name] = math.sqrt(best / n / 3.0)
                rows += [(name, s, v.tolist(), 3.0) for s, side in enumerate((one, two)) for v in side]
    rows += [("uneven", 0, [0.0, 1.0], 1.0), ("large", 0, [0.0], 1.0), ("large", 1, [0.5], 1.0)]
    got = {r.case: r for r in S.optimal_w2(spark.createDataFrame(rows, "case string, side int, x array<double>, scale double")).collect()}
    assert got.pop("uneven").violation == "sizes differ: 1 and 0" and got.pop("large").w2 == pytest.approx(0.5)
    assert {k: r.w2 for k, r in got.items()} == pytest.approx(want, abs=1e-7)
    cost = rng.random((60, 60))
    assert cost[np.arange(60), S.assignment(cost)].sum() == pytest.approx(least_total(cost))


def least_total(cost):
    """The same by cancelling cycles that save cost, from any assignment on."""
    n = len(cost)
    at = np.arange(n)
    while True:
        # save[i, j]: what row i loses by taking the column of row j
        save = cost[:, at] - cost[np.arange(n), at][:, None]
        dist, back = save.copy(), np.tile(np.arange(n)[:, None], (1, n))
        for k in range(n):
            new = dist[:, k : k + 1] + dist[k : k + 1]
            better = new < dist - 1e-12
            dist, back = np.where(better, new, dist), np.where(better, back[k : k + 1], back)
            if (np.diag(dist) < -1e-12).any():
                break
        worst = int(np.diag(dist).argmin())
        if dist[worst, worst] >= -1e-12:
            return cost[np.arange(n), at].sum()
        node, seen = worst, []
        while node not in seen:
            seen.append(node)
            node = int(back[worst, node])
        cycle = seen[seen.index(node) :][::-1]
        new = at.copy()
        for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True):
            new[a] = at[b]
        if cost[np.arange(n), new].sum() >= cost[np.arange(n), at].sum():
            return cost[np.arange(n), at].sum()
        at = new


def test_superposition_of_rows(spark, ensembles):
    x, rows, _ = ensembles
    from pyspark.sql import functions as F

    target = x["e0"][3].ravel().tolist()
    out = S.fitted(rows.where("ensemble_id = 'e1'").select(F.lit("s").alias("space"), "ensemble_id", "frame_idx", "v", F.array(*[F.lit(c) for c in target]).alias("onto"))).collect()
    want = onto(x["e1"], x["e0"][3])
    assert all(np.allclose(np.array(r.v).reshape(8, 3), want[r.frame_idx]) for r in out) and len(out) == 20
    assert E.turned(x["e1"][:1], x["e0"][3][None])[1].shape == (1, 3, 3)


def test_assignment_of_large_clouds(spark, monkeypatch):
    """Clouds of any size have a value: on a line the best assignment joins equal ranks."""
    rng = np.random.default_rng(9)
    sides = [np.round(rng.normal(size=2300), 3), rng.normal(size=2300) * 1.3 + 0.2]
    rows = [("line", s, [float(x)], 3.0) for s, side in enumerate(sides) for x in side]
    (got,) = S.optimal_w2(spark.createDataFrame(rows, "case string, side int, x array<double>, scale double")).collect()
    a, b = map(np.sort, sides)
    assert got.violation is None and got.w2 == pytest.approx(math.sqrt(((a - b) ** 2).mean() / 3.0))
    cost = rng.random((80, 80))
    monkeypatch.setattr(S, "PRICED", 10)
    monkeypatch.setattr(S, "CELLS", 700)
    assert cost[np.arange(80), S.assignment(cost)].sum() == pytest.approx(least_total(cost))
    assert S.assignment(np.zeros((30, 30))).tolist() and len(set(S.assignment(np.ones((30, 30))).tolist())) == 30
