"""Alignments, picks, rigid bodies, votes, provenance, the arrow audit and agreement, against plain versions."""

import collections
import itertools
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ensemblespark.operators import arrow as A
from ensemblespark.operators import confidence as K
from ensemblespark.operators import ensembles as E
from ensemblespark.operators import provenance as P
from ensemblespark.operators import structure as S
from ensemblespark.operators import windows as W


def plain_align(x, y):
    """Affine gaps cell by cell, with the same order among equal ways."""
    low = -(10**9)
    n, m = len(x), len(y)
    best = {(i, j): [low] * 3 for i in range(n + 1) for j in range(m + 1)}
    way = {}
    best[0, 0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                options = [best[i - 1, j - 1][s] for s in range(3)]
                k = options.index(max(options))
                best[i, j][0], way[i, j, 0] = options[k] + (2 if x[i - 1] == y[j - 1] else -1), k
            if i:
                options = [best[i - 1, j][0] - 10, best[i - 1, j][1] - 0.5, best[i - 1, j][2] - 10]
                k = options.index(max(options))
                best[i, j][1], way[i, j, 1] = options[k], k
            if j:
                options = [best[i, j - 1][0] - 10, best[i, j - 1][1] - 10, best[i, j - 1][2] - 0.5]
                k = options.index(max(options))
                best[i, j][2], way[i, j, 2] = options[k], k
    s = best[n, m].index(max(best[n, m]))
    score, mapping, i, j = best[n, m][s], [None] * n, n, m
    while i or j:
        k = way[i, j, s]
        if s == 0:
            mapping[i - 1] = j - 1
        i, j, s = i - (s != 2), j - (s != 1), k
    return score, mapping


def test_alignment_equals_plain_version(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        x = "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 24)))
        y = "".join(c for c in x if rng.random() > 0.15) + "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 6)))
        y = "".join(rng.choice("ACDE") if rng.random() < 0.2 else c for c in y)
        if k % 3 == 0:
            cut = rng.randint(0, max(0, len(y) - 1))
            y = y[:cut] + "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 12))) + y[cut:]
        rows.append((k, k + 1, x, y))
    rows += [(500, 1, "", ""), (501, 1, "ACD", ""), (502, 1, "", "ACD"), (503, 1, None, "A"), (504, 1, "A" * 40, "A" * 40)]
    got = {r.a: r for r in S.align_pairs(spark.createDataFrame(rows, "a long, b long, ref string, other string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for a, _, x, y in rows:
        score, mapping = plain_align(x or "", y or "")
        r = got[a]
        assert r.score == score and r.mapping == mapping
        assert r.covered == sum(v is not None for v in mapping)
        assert r.coverage == (pytest.approx(r.covered / len(x)) if x else None)
        assert r.identity == (pytest.approx(sum(v is not None and x[i] == y[v] for i, v in enumerate(mapping)) / len(x)) if x else None)
    many = [tuple(x.encode() for x in (r[2] or "", r[3] or "")) for r in rows]
    order = sorted(range(len(many)), key=lambda k: (len(many[k][0]), len(many[k][1])))
    n, m = (np.array([len(many[k][s]) for k in order]) for s in (0, 1))
    monkeypatch.setattr(S, "CELLS", 3000)
    parts = list(S._slices(n, m))
    assert len(parts) > 5 and parts[0][0] == 0 and parts[-1][1] == len(many) and all(a[1] == b[0] for a, b in itertools.pairwise(parts))
    for i, j in parts:
        score, _ = S.align([many[k][0] for k in order[i:j]], [many[k][1] for k in order[i:j]])
        assert [s / 2 for s in score.tolist()] == [got[rows[k][0]].score for k in order[i:j]]


def test_admission(spark):
    rows = spark.createDataFrame([(1, 4, 4, 0.75), (2, 4, 3, 1.0), (3, 4, 4, 0.5), (4, 0, 0, None)], "a int, n long, covered long, identity double")
    assert {r.a: r.why for r in rows.select("a", S.admission(0.7).alias("why")).collect()} == {1: None, 2: "covers 3/4 reference residues", 3: "identity 0.50 < 0.70", 4: "empty reference"}


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9, 1.0])
def test_sharing_pairs_equal_all_pairs(spark, share):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 60))) for _ in range(25)]
    seqs = base + [s[rng.randint(0, 3) :] + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for s in base] + base[:3] + ["abc", "ab", "", "aaaaaaaaaaaa", "aaaa", "aaaaa"]
    frame = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    sets = {i: {s[k : k + 4] for k in range(max(1, len(s) - 3))} for i, s in enumerate(seqs) if s}
    want = {}
    for i, j in itertools.combinations(sorted(sets), 2):
        both, least = len(sets[i] & sets[j]), min(len(sets[i]), len(sets[j]))
        if both and both / least >= share - 1e-12:
            want[i, j] = (both, pytest.approx(both / least))
    assert {(r.a, r.b): (r.shared, r.containment) for r in S.sharing_pairs(frame, 4, share).collect()} == want


def test_farthest_points_equal_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name, n in (("a", 30), ("b", 4), ("c", 1), ("d", 5), ("e", 12)):
        v = rng.normal(size=(n, 6)) * 3
        if name == "e":
            v[5] = v[2]
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2) / 2)
        rows += [(name, i, x.tolist()) for i, x in enumerate(v)]
        start = int(np.round(d.mean(1), 9).argmin())
        if n <= 5:
            rest = sorted((i for i in range(n) if i != start), key=lambda i: (d[start][i], i))  # noqa: B023
            want[name] = [start, *rest]
            continue
        chosen = [start]
        while len(chosen) < 5:
            left = [i for i in range(n) if i not in chosen]
            chosen.append(max(left, key=lambda i: (min(d[i][c] for c in chosen), -i)))  # noqa: B023
        want[name] = chosen
    got = collections.defaultdict(dict)
    for r in S.farthest_points(spark.createDataFrame(rows, "cluster string, item long, v array<double>").repartition(4), 5).collect():
        got[r.cluster][r.place] = r.item
    assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == want


def long(spark, ensembles):
    rows = [(e, f, r, *map(float, x[f, r])) for e, x in ensembles.items() for f in range(len(x)) for r in range(x.shape[1])]
    return spark.createDataFrame(rows, "ensemble_id string, frame_idx long, res_idx int, x double, y double, z double").repartition(4)


def plain_bodies(x, least=8, contrast=4.0):
    n = x.shape[1]
    whole = [[(1, n)]]
    if n < 2 * least or len(x) < 3:
        return whole
    d = np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(3))
    v = d.var(0)
    rows = v / (np.sqrt((v**2).sum(1, keepdims=True)) + 1e-12)
    far = np.round(((rows[:, None] - rows[None]) ** 2).sum(2), 12)
    i, j = np.unravel_index(far.argmax(), far.shape)
    centres, label = [rows[i], rows[j]], None
    for _ in range(60):
        new = np.array([int(((r - centres[1]) ** 2).sum() < ((r - centres[0]) ** 2).sum()) for r in rows])
        if label is not None and (new == label).all():
            break
        label = new
        centres = [rows[label == c].mean(0) if (label == c).any() else centres[c] for c in (0, 1)]
    a, b = label == 0, label == 1
    if a.sum() < least or b.sum() < least:
        return whole
    if v[np.ix_(a, b)].mean() < contrast * max((v[np.ix_(a, a)].mean() + v[np.ix_(b, b)].mean()) / 2, 1e-9):
        return whole
    runs = [[k, *(lambda g: (g[0], g[-1]))(list(g))] for k, g in [(k, [i for i, _ in g]) for k, g in itertools.groupby(enumerate(label.tolist()), key=lambda t: t[1])]]
    merged = []
    for r in runs:
        if merged and r[2] - r[1] + 1 < least:
            merged[-1][2] = r[2]
        elif merged and merged[-1][0] == r[0]:
            merged[-1][2] = r[2]
        else:
            merged.append(r)
    groups = collections.defaultdict(list)
    for k, s, e in merged:
        groups[k].append((s + 1, e + 1))
    bodies = sorted(groups.values())
    return bodies if len(bodies) > 1 else whole


def test_rigid_bodies_find_the_hinge(spark):
    rng = np.random.default_rng(3)
    base = np.cumsum(rng.normal(size=(30, 3)) + [1.5, 0, 0], 0)
    hinge, inserted, floppy = [], [], []
    for _ in range(25):
        t = rng.normal() * 0.9
        turn = np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
        x = base.copy()
        x[14:] = (x[14:] - x[14]) @ turn.T + x[14]
        hinge.append(x + rng.normal(size=x.shape) * 0.05)
        y = base.copy()
        y[10:20] += np.array([0, 0, 6]) * rng.normal()
        inserted.append(y + rng.normal(size=y.shape) * 0.05)
        floppy.append(base + rng.normal(size=base.shape))
    sets = {"hinge": np.array(hinge), "inserted": np.array(inserted), "floppy": np.array(floppy), "few": np.array(hinge[:2]), "short": np.array(hinge)[:, :12]}
    got = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in S.rigid_bodies(long(spark, sets)).collect():
        got[r.ensemble_id][r.body].append((r.first, r.last))
    found = {e: [sorted(b[k]) for k in sorted(b)] for e, b in got.items()}
    assert found == {e: plain_bodies(x) for e, x in sets.items()}
    assert len(found["hinge"]) == 2 and len(found["inserted"][0]) == 2 and found["floppy"] == [[(1, 30)]]


def test_absorbed_runs(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(30):
        labels = [rng.choice("ab") for _ in range(rng.randint(1, 4)) for _ in range(1)]
        labels = [x for x in (rng.choice("abc") for _ in range(12)) for _ in range(rng.choice([1, 1, 2, 3, 5]))]
        rows += [(g, i, x) for i, x in enumerate(labels)]
        merged = []
        for x, group in itertools.groupby(enumerate(labels), key=lambda t: t[1]):
            at = [i for i, _ in group]
            if merged and (len(at) < 3 or merged[-1][0] == x):
                merged[-1][2] = at[-1]
            else:
                merged.append([x, at[0], at[-1]])
        want[g] = [tuple(m) for m in merged]
    got = collections.defaultdict(list)
    for r in W.absorbed_runs(spark.createDataFrame(rows, "g int, i int, x string"), "g", "i", "x", 3).orderBy("g", "first").collect():
        got[r.g].append((r.x, r["first"], r["last"]))
    assert dict(got) == want


def plain_letters(n, c, o):
    size = len(n)
    h = [None] + [n[i] + (c[i - 1] - o[i - 1]) / np.linalg.norm(c[i - 1] - o[i - 1]) for i in range(1, size)]
    bond = np.zeros((size, size), bool)
    for d in range(1, size):
        for a in range(size):
            if abs(d - a) > 2:
                e = 332 * 0.42 * 0.2 * (1 / np.linalg.norm(o[a] - n[d]) + 1 / np.linalg.norm(c[a] - h[d]) - 1 / np.linalg.norm(o[a] - h[d]) - 1 / np.linalg.norm(c[a] - n[d]))
                bond[d, a] = e < -0.5
    b = lambda d, a: 0 <= d < size and 0 <= a < size and bond[d, a]
    out = ["C"] * size
    for i in range(size):
        for j in range(size):
            if abs(i - j) >= 3 and 0 < i < size - 1 and 0 < j < size - 1:
                anti = (b(i, j) and b(j, i)) or (b(j + 1, i - 1) and b(i + 1, j - 1))
                para = (b(i, j - 1) and b(j + 1, i)) or (b(j, i - 1) and b(i + 1, j))
                if anti or para:
                    out[i] = out[j] = "E"
    for i in range(size - 4):
        if b(i + 4, i) and b(i + 5, i + 1):
            out[i + 1 : i + 5] = "HHHH"
    return out


def test_votes_equal_plain_version(spark):
    rng = np.random.default_rng(12)
    frames, want = [], collections.defaultdict(list)
    for e, (size, spread, count) in enumerate(((14, 3.0, 12), (30, 4.0, 9), (40, 16.0, 5))):
        for f in range(count):
            n, c = rng.normal(size=(2, size, 3)) * spread
            o = c + rng.normal(size=(size, 3)) * 0.6
            for r in range(size):
                frames.append((e, f, r, *map(float, (*n[r], *c[r], *o[r]))))
            want[e].append(plain_letters(n, c, o))
    # an ideal helix: every residue but the ends bonded four back
    turn, rise = math.radians(100), 1.5
    place = lambda k, r, shift, z: np.array([r * math.cos(turn * k + shift), r * math.sin(turn * k + shift), rise * k + z])
    n, c, o = (np.array([place(k, *p) for k in range(16)]) for p in ((1.55, 0.0, 0.0), (1.65, 1.05, 1.1), (2.0, 1.2, 2.3)))
    frames += [(9, 0, r, *map(float, (*n[r], *c[r], *o[r]))) for r in range(16)]
    want[9].append(plain_letters(n, c, o))
    kind = "ensemble_id int, frame_idx int, res_idx int, " + ", ".join(f"{p}{k} double" for p in "nco" for k in "xyz")
    table = spark.createDataFrame(frames, kind).repartition(4)
    letters = S.secondary(table, S.hydrogen_bonds(table))
    got = {(r.ensemble_id, r.frame_idx, r.res_idx): r.ss for r in letters.collect()}
    assert got == {(e, f, r): x for e, all_ in want.items() for f, row in enumerate(all_) for r, x in enumerate(row)}
    assert {"H", "E", "C"} <= set(got.values())
    votes = {(r.ensemble_id, r.res_idx): (r.ss, r.agreement) for r in S.ss_vote(letters).collect()}
    for e, all_ in want.items():
        for r in range(len(all_[0])):
            letter, n = collections.Counter(row[r] for row in all_).most_common(1)[0]
            assert votes[e, r] == (letter, pytest.approx(n / len(all_)))


def test_provenance(spark):
    deep = {"a": {"b": {"c": {"d": {"model_name": "too-deep-interp"}}}}}
    cases = {
        "top": ({"weight_family": " Base-20M ", "metadata": {"model_name": "interp"}}, "base", "Base-20M"),
        "order": ({"model_name": "x-interp", "weight_family": "my-base-20m"}, "base", "my-base-20m"),
        "blank": ({"weight_family": "  ", "metadata": {"Model_Name": "20m_interp"}}, "interp", "20m_interp"),
        "not text": ({"weight_family": 7, "model_cfg": {"x": {"model_family": ["other"]}}}, "foreign", "other"),
        "metadata first": ({"model_cfg": {"model_name": "zzz"}, "metadata": {"n": {"checkpoint_name": "base-20m"}}}, "base", "base-20m"),
        "hint": ({"model_cfg": {"net": {"task_mode": "Interp"}}}, "interp", None),
        "hint list": ({"model_cfg": {"train_tasks": ["forward", "interp"]}}, "interp", None),
        "unrelated key": ({"model_cfg": {"interpolation": "bilinear", "upsample": "interp"}}, "unverified", None),
        "tasks": ({"tasks": ["iid", "interp"], "weight_family": "base-20m"}, "tasks", "base-20m"),
        "fine tasks": ({"tasks": ["iid", "forward"], "weight_family": "base-20m"}, "base", "base-20m"),
        "depth": ({"metadata": deep}, "interp", "too-deep-interp"),
        "beyond depth": ({"metadata": {"z": deep}}, "unverified", None),
        "nothing": ({}, "unverified", None),
    }
    rows = [(k, json.dumps(v[0])) for k, v in cases.items()] + [("list", "[1]"), ("broken", "{"), ("null", None), ("text", '"base-20m"')]
    got = {r.id: (r.tag, r.declared) for r in P.provenance(spark.createDataFrame(rows, "id string, json string"), "base.?20m").collect()}
    want = {k: v[1:] for k, v in cases.items()} | {k: ("malformed", None) for k in ("list", "broken", "null", "text")}
    assert got == want


def test_discriminant_equals_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = []
    for cell, drift, n in (("drifts", 0.8, 120), ("still", 0.0, 120), ("thin", 0.5, 8)):
        for k in range(n):
            x = rng.normal(size=5) + drift * np.array([1, 0, 0, 0.5, 0])
            rows.append((cell, f"{cell}{k}", x.tolist() if k % 10 else [0.0] * 5, k % 2 == 0))
    table = spark.createDataFrame(rows, "cell string, key string, x array<double>, train boolean").repartition(5)
    got = {r.cell: r for r in A.discriminant(table, 80).collect()}
    signs = {(r.key, r.k): r.s for r in table.select("key", F.explode(F.sequence(F.lit(0), F.lit(79))).alias("k")).select("key", "k", A.sign(F.col("key"), F.col("k")).alias("s")).collect()}
    assert abs(sum(signs.values())) < 4 * math.sqrt(len(signs))
    assert got["drifts"].status == "arrowed" and got["thin"].status == "unestimable" and got["thin"].accuracy is None
    for cell in ("drifts", "still"):
        train = np.array([x for c, _, x, t in rows if c == cell and t])
        test = [(k, np.array(x)) for c, k, x, t in rows if c == cell and not t]
        m = train.mean(0)
        cov = np.cov(train.T, ddof=1)
        w = np.linalg.solve(cov + 1e-3 * (np.trace(cov) / 5 + 1e-12) * np.eye(5), m)
        margins = {k: float(x @ (w / np.linalg.norm(w))) for k, x in test}
        credit = lambda v: np.mean([1.0 if a > 0 else 0.5 if a == 0 else 0.0 for a in v])
        accuracy = credit(margins.values())
        null = [credit([v * signs[k, draw] for k, v in margins.items()]) for draw in range(80)]  # noqa: B023
        r = got[cell]
        assert (r.n_train, r.n_test) == (len(train), len(test))
        assert r.accuracy == pytest.approx(accuracy) and r.separation == pytest.approx(max(accuracy, 1 - accuracy))
        assert r.null_q99 == pytest.approx(np.quantile([max(a, 1 - a) for a in null], 0.99))
        assert r.strength == pytest.approx(max(0, 2 * r.separation - 1) if r.separation > r.null_q99 else 0)


def test_gate_search_equals_plain_loop(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for audit in range(25):
        cells = [(s, t, rng.choice([0, 5, 50, 400]), rng.choice(["clean", "clean", "clean", "arrowed", "unestimable" if audit % 3 else "clean"]), round(rng.random() * 0.4, 3)) for s in (0, 10, 50) for t in (1, 2, 4, 8) if rng.random() < 0.9]
        rows += [(audit, *c) for c in cells]
        total, best, feasible = sum(c[2] for c in cells), None, 0
        for s in sorted({c[0] for c in cells}):
            for t in sorted({c[1] for c in cells}):
                mine = [c for c in cells if c[0] >= s and c[1] <= t]
                arrowed = [c for c in mine if c[3] == "arrowed"]
                if total and 0.5 * sum(c[2] * c[4] for c in arrowed) / total <= 0.01 and max([c[4] for c in arrowed], default=0) <= 0.25:
                    feasible += 1
                    if not any(c[3] == "unestimable" and c[2] for c in mine):
                        row = (-sum(c[2] for c in mine) / total, s, -t)
                        best = row if best is None else min(best, row)
        want[audit] = (best[1], -best[2]) if best else (None, None)
    table = spark.createDataFrame(rows, "audit int, start int, step int, emit long, status string, strength double")
    got = {r.audit: (r.min_start, r.max_step) for r in A.gate_search(A.gate_grid(table)).collect()}
    assert got == want and (None, None) in want.values() and len(set(want.values())) > 3


def test_agreement_of_an_ensemble_with_itself(spark):
    rng = np.random.default_rng(0)
    rigid = rng.normal(size=(12, 3)) * 4
    moved = []
    for _ in range(6):
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        moved.append(rigid @ (turn * np.sign(np.linalg.det(turn))).T + rng.normal(size=3) * 9)
    sets = {"rigid": np.array(moved), "loose": np.array(moved) + rng.normal(size=(6, 12, 3)), "one": np.array(moved[:1])}
    rows = E.flat(long(spark, sets))
    cases = spark.createDataFrame([("self", "rigid", "rigid"), ("x", "rigid", "loose"), ("y", "loose", "rigid"), ("loose", "loose", "loose"), ("one", "one", "one")], "case string, a string, b string")
    got = collections.defaultdict(dict)
    for r in K.cross_lddt(rows, cases, 60, 3, radius=9.0).collect():
        got[r.case][r.res_idx] = r
    assert set(got) == {"self", "x", "y", "loose"} and all(len(v) == 12 for v in got.values())
    assert all(r.lddt == pytest.approx(1) and r.sd == pytest.approx(0, abs=1e-9) for r in got["self"].values())
    assert all(r.lddt < 1 for r in got["loose"].values())  # no frame against itself
    draws = {(r.case, r.k): (r.fa, r.fb) for r in K.frame_draws(cases, rows.groupBy("ensemble_id").agg(F.count("*").alias("n")), 60, 3).collect()}
    assert all(a != b for (c, _), (a, b) in draws.items() if c in ("self", "loose"))
    for name, a, b in (("x", "rigid", "loose"), ("y", "loose", "rigid"), ("loose", "loose", "loose")):
        scores = np.zeros((60, 12))
        for k in range(60):
            fa, fb = draws[name, k]
            da, db = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) for v in (sets[a][fa], sets[b][fb]))
            kept = np.mean([np.abs(da - db) < t for t in (0.5, 1, 2, 4)], axis=0)
            off = ~np.eye(12, dtype=bool)
            for i in range(12):
                one = [kept[i][m[i] & off[i]].mean() if (m[i] & off[i]).any() else 0.0 for m in (db < 9, da < 9)]
                scores[k, i] = sum(one) / 2
        for i in range(12):
            assert got[name][i].lddt == pytest.approx(scores[:, i].mean()) and got[name][i].sd == pytest.approx(scores[:, i].std(), abs=1e-9)


def test_runs_leave_in_parts(monkeypatch):
    """A batch of long texts gives its runs in parts of bounded size, all of them."""
    monkeypatch.setattr(S, "RUNS", 100)
    texts = ["".join(random.Random(i).choices("ACDEFGH", k=90)) for i in range(20)]
    parts = list(S._runs(4)([pa.RecordBatch.from_pydict({"id": list(range(20)), "seq": texts})]))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 200
    assert sum(p.num_rows for p in parts) == sum(len({t[i : i + 4] for i in range(87)}) for t in texts)


def test_windows_across_batches_and_gaps(spark):
    rng = random.Random(9)
    rows = [(u, o, f, rng.random()) for u in range(6) for o in range(1 + u % 2) for f in range(30) if (u, f) != (2, 11) and (u, o, f) != (3, 1, 17)]
    rows = [(u, o, f, None if (u, f) == (4, 20) else z) for u, o, f, z in rows]
    known = {(u, o, f): z for u, o, f, z in rows}
    obs = {u: sorted({r[1] for r in rows if r[0] == u}) for u in range(6)}
    want = {(u, s, f) for u in range(6) for s in (1, 2) for f in range(30) if all(known.get((u, o, f + k * s)) is not None for o in obs[u] for k in range(9)) and all((u, o, f + k) in known for o in obs[u] for k in range(8 * s + 1))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = A.window_matrix(spark.createDataFrame(rows, "unit int, obs int, frame_idx int, z double"), [1, 2], 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r.unit, r.step, r.start) for r in got} == want
    for r in got:
        t = np.arange(9) / 4 - 1
        assert len(r.x) == 5 * len(obs[r.unit])
        assert r.x[0] == pytest.approx(sum(known[r.unit, 0, r.start + k * r.step] * t[k] for k in range(9)) / (t @ t))


def test_sharing_pairs_in_passes_keep_no_runs(spark, monkeypatch):
    """Runs are met a part of all hashes at a time; what is kept between is far less than the runs, and pairs stay the same."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefgh", k=300)) for _ in range(30)]
    texts += [t[:200] + "".join(rng.choices("abcdefgh", k=100)) for t in texts[:5]] + [texts[0], texts[1][40:90]]
    sets = [{t[i : i + 6] for i in range(len(t) - 5)} for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) for i, j in itertools.combinations(range(len(texts)), 2) if 2 * len(sets[i] & sets[j]) >= min(len(sets[i]), len(sets[j]))}
    kept, keep = [], S.keep
    monkeypatch.setattr(S, "LETTERS", 3000)
    monkeypatch.setattr(S, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(S, "forget", lambda *tables: None)
    got = {(r.a, r.b): r.shared for r in S.sharing_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, seq string"), 6, 0.5).collect()}
    assert got == want and len(want) >= 7
    assert len(kept) > 8 and max(t.count() for t in kept) < sum(map(len, sets)) / 4
