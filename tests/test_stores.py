"""Folders of files, structure checks, domains, id lists and exact enumerations against plain versions."""

import itertools
import math

import numpy as np
import pytest

from ensemblespark.operators import ensembles as E
from ensemblespark.operators import stores as D
from ensemblespark.operators import windows as W
from ensemblespark.sources import text as T


def test_layouts_of_folders(spark, tmp_path):
    files = [
        "1abc_R/protein/1abc_R.pdb", "1abc_R/protein/other.pdb", "1abc_R/protein/1abc_R_prod_R1.xtc", "1abc_R/protein/1abc_R_prod_R1_fit.xtc", "1abc_R/protein/1abc_R_prod_R2_fit.xtc", "1abc_R/protein/loose.xtc", "1abc_R/analysis/1abc_R_R3.xtc", "1abc_R/seqres.txt",
        "stat/A.pdb", "stat/B.pdb", "stat/protein/ref.pdb", "only_analysis/analysis/x.pdb", "no_moves/protein/x.pdb", "deep/sub/dir/m.xtc", "deep/A.pdb", "skipped/readme.md", "top.pdb", "far/protein/sub/x.pdb",
    ]
    for f in files:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    listing = T.store_files(spark, str(tmp_path))
    assert sorted(r.path for r in listing.collect()) == sorted(files)
    got = {(r.family_id, r.member_id): (r.layout, r.path, r.topology, r.error) for r in D.family_dirs(listing).collect()}
    p = "1abc_R/protein/"
    assert got == {
        ("1abc_R", "R1"): ("trajectory", p + "1abc_R_prod_R1_fit.xtc", p + "1abc_R.pdb", None), ("1abc_R", "R2"): ("trajectory", p + "1abc_R_prod_R2_fit.xtc", p + "1abc_R.pdb", None),
        ("1abc_R", "loose"): ("trajectory", p + "loose.xtc", p + "1abc_R.pdb", None), ("1abc_R", "ref"): ("trajectory", p + "1abc_R.pdb", None, None),
        ("stat", "A"): ("static", "stat/A.pdb", None, None), ("stat", "B"): ("static", "stat/B.pdb", None, None),
        ("only_analysis", None): ("trajectory", None, None, "no protein structure"), ("no_moves", None): ("trajectory", None, None, "no replica trajectories"), ("deep", None): ("trajectory", None, None, "no protein structure"),
    }


def test_a_listing_is_read_once(spark):
    paths = ["s/a.pdb", "s/a.pdb", "s//a.pdb", "s/b.c.pdb", "s/.pdb", "t/protein/t.pdb", "t/protein/t.pdb", "t/protein/a.pdb", "t/protein/x_R1.xtc", "t/protein/x_R1.xtc", "t/protein/w_R1.xtc", "t/other/z.pdb"]
    found = D.family_dirs(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("s", "static", "a", "s/a.pdb", None, None), ("s", "static", "a", "s//a.pdb", None, None), ("s", "static", "b.c", "s/b.c.pdb", None, None), ("s", "static", "", "s/.pdb", None, None),
        ("t", "trajectory", "R1", "t/protein/w_R1.xtc", "t/protein/t.pdb", None), ("t", "trajectory", "ref", "t/protein/t.pdb", None, None),
    ], key=str)
    assert found._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") <= 1


def test_faults_of_structure_files(spark):
    def residues(name, *rows):
        return [(name, i, 0, *r) for i, r in enumerate(rows)]

    plain = lambda n, chain="A": (False, "", chain, n, "")
    rows = residues("good", plain(1), plain(1), plain(2)) + residues("chains", plain(1), plain(2, "B")) + residues("hetero", plain(1), (True, "", "A", 9, "")) + residues("water", (True, "", "A", 1, ""))
    rows += residues("icode", plain(1), (False, "", "A", 1, "A")) + residues("alt", (False, "A", "A", 1, ""), (False, "B", "A", 1, ""), plain(2)) + residues("one alt", (False, "A", "A", 1, ""), plain(2))
    rows += residues("again", plain(1), plain(2), plain(1)) + residues("gap", plain(1), plain(3)) + residues("late", plain(2), plain(3)) + [("models", 0, 0, *plain(1)), ("models", 1, 1, *plain(1))]
    table = spark.createDataFrame(rows, "file string, line_no int, model int, hetero boolean, altloc string, chain string, resseq int, icode string").repartition(3)
    assert {r.file: r.violation for r in D.indexable_check(table).collect()} == {
        "good": None, "chains": "chains", "hetero": "hetero", "water": "no polymer", "icode": "insertion codes", "alt": "alternate locations", "one alt": None, "again": "repeated number", "gap": "numbering", "late": "numbering", "models": "models",
    }


def test_atoms_of_a_selection(spark):
    rows = [("a", "CA", "C"), ("a", "HA", "H"), ("a", "1HB", ""), ("a", "HG", None), ("a", "CB", None), ("a", "HG", "Hg"), ("b", "N", "N")]
    atoms = spark.createDataFrame(rows, "file string, atom string, element string")
    names = lambda s: sorted((r.file, r.atom, r.element) for r in D.atom_select(atoms, s).na.fill("").collect())
    assert names("ca") == [("a", "CA", "C")] and names("heavy") == [("a", "CA", "C"), ("a", "CB", ""), ("a", "HG", "Hg"), ("b", "N", "N")] and len(names("all")) == 7
    assert [tuple(r) for r in D.atom_faults(atoms, "ca").collect()] == [("b", 1)]
    with pytest.raises(ValueError, match="unknown"):
        D.atom_select(atoms, "backbone")


def fitted(x, target, use):
    out = []
    for f in x:
        a, b = f[use] - f[use].mean(0), target[use] - target[use].mean(0)
        u, _, vt = np.linalg.svd(a.T @ b)
        d = np.sign(np.linalg.det(u @ vt))
        out.append((f - f[use].mean(0)) @ (u @ np.diag([1, 1, d]) @ vt) + target[use].mean(0))
    return np.array(out)


def test_report_of_domains(spark):
    rng = np.random.default_rng(4)
    base = np.cumsum(rng.normal(size=(14, 3)) + [2, 0, 0], 0)
    x = []
    for _ in range(20):
        y = base + rng.normal(size=base.shape) * 0.2
        y[8:] += rng.normal(size=3)
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        x.append(y @ (q * np.sign(np.linalg.det(q))).T + rng.normal(size=3) * 5)
    x = np.array(x)
    one, two, linker = list(range(6)), list(range(8, 14)), [6, 7]
    frames = spark.createDataFrame([("e", f, v.ravel().tolist()) for f, v in enumerate(x)], "ensemble_id string, frame_idx int, v array<double>").repartition(3)
    got = {r.metric: r.value for r in D.flexibility_report(frames, one, two, linker).collect()}
    spread = lambda use: np.sqrt(((y := fitted(x, x[0], use)) - y.mean(0)) ** 2).__pow__(2).sum(2).mean(0) ** 0.5
    s1, s2 = spread(one), spread(two)
    apart = np.linalg.norm(x[:, one].mean(1) - x[:, two].mean(1), axis=1)
    axis = lambda p: np.linalg.svd(p - p.mean(0))[2][0]
    angle = [math.degrees(math.acos(min(1, abs(axis(f[one]) @ axis(f[two]))))) for f in x]
    bonds = np.linalg.norm(np.diff(x, axis=1), axis=2)
    want = {"domain1_mean_rmsf": s1[one].mean(), "domain1_max_rmsf": s1[one].max(), "domain2_mean_rmsf": s2[two].mean(), "domain2_max_rmsf": s2[two].max(), "linker_mean_rmsf": s1[linker].mean(), "linker_max_rmsf": s1[linker].max(), "domain2_rmsf_about_domain1": s1[two].mean()}
    for name, v in (("apart", apart), ("angle", np.array(angle))):
        want |= {f"{name}_mean": v.mean(), f"{name}_sd": v.std(), f"{name}_min": v.min(), f"{name}_max": v.max()}
    want |= {"apart_relative_width": apart.std() / apart.mean(), "bond_mean": bonds.mean(), "bond_min": bonds.min(), "bond_max": bonds.max(), "bonds_outside_percent": 100 * ((bonds > 4.5) | (bonds < 3)).mean()}
    assert got == pytest.approx(want, abs=1e-6)


def test_lists_of_ids(spark):
    families = spark.createDataFrame([("1abc_A",), ("1abc_B",), ("2xyz_A",), ("3def_A",)], "family_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    kept, report = D.id_filters(families, ids(" 2XYZ ", ""), ids("1ABC_a", "3def"))
    assert sorted(r.family_id for r in kept.collect()) == ["1abc_A", "3def_A"]
    assert [tuple(r) for r in report.collect()] == [("exclude", 4, 1, 3, None), ("allow", 3, 2, 2, None)]
    assert D.id_filters(families, None, ids("2xyz"))[1].first().warning == "drops half or more"
    with pytest.raises(ValueError, match="allow list leaves none of 4"):
        D.id_filters(families, None, ids("nothing"))


def test_resamples_and_signs_are_enumerated(spark):
    diffs = {"m": [0.10, 0.12, 0.09, 0.11, 0.13], "one": [0.4], "mixed": [0.3, -0.1, 0.2, 0.0]}
    table = spark.createDataFrame([(m, f"f{i}", v) for m, vs in diffs.items() for i, v in enumerate(vs)], "metric string, family string, diff double")
    boot = {r.metric: r for r in E.bootstrap(table, "metric", "family", "diff", 50, 1).collect()}
    sign = {r.metric: r for r in E.sign_flips(table, "metric", "family", "diff", 50, 1).collect()}
    for m, v in diffs.items():
        n = len(v)
        means = [np.mean([v[i] for i in pick]) for pick in itertools.product(range(n), repeat=n)]
        assert boot[m].resamples == n**n and (boot[m].low, boot[m].high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
        flips = [abs(np.mean([a * s for a, s in zip(v, signs, strict=True)])) for signs in itertools.product((-1, 1), repeat=n)]
        assert sign[m].signs == 2**n and sign[m].p == pytest.approx(np.mean([f >= abs(np.mean(v)) - 1e-12 for f in flips])) and sign[m].floor == 2 / 2**n
    assert (boot["m"].low, boot["m"].high) == (pytest.approx(0.098), pytest.approx(0.122)) and sign["m"].p == 0.0625
    many = spark.createDataFrame([("m", f"f{i:02}", 0.1 * i - 1) for i in range(21)], "metric string, family string, diff double")
    assert E.bootstrap(many, "metric", "family", "diff", 50, 1).first().resamples == 50 and E.sign_flips(many, "metric", "family", "diff", 50, 1).first().signs == 50


def test_lagged_pairs_stay_in_their_run(spark):
    rows = [("r", i, s, float(i)) for i, s in enumerate("aabaabbb")]
    got = sorted((r.frame_idx, r.later) for r in W.lag_pairs(spark.createDataFrame(rows, "replica string, frame_idx int, segment string, value double"), 2).collect())
    assert got == [(5, 7.0)]
