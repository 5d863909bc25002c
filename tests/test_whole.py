"""Queries that have no SQL, against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblespark.operators import alignments as A
from ensemblespark.operators import ensembles as E
from ensemblespark.operators import selection as S
from ensemblespark.operators import windows as W
from ensemblespark.plans import registry
from ensemblespark.sources import text as T

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Long documents; some share an opening of 500 letters, some are equal."""
    rng = random.Random(3)
    long = lambda n: "".join(rng.choice("ABCdef  -") for _ in range(n))
    opening = long(500)
    rows = [(i, opening + long(80), f"s{i % 3}", "en") for i in range(6)] + [(i, long(rng.choice([3, 60, 700])), f"s{i % 2}", "de") for i in range(6, 20)]
    rows += [(20, rows[0][1], "s1", "en"), (21, "", "s0", "en"), (22, "a b", None, "fr"), (23, "a c", None, "fr")]
    at = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, rows


def aligned(rows):
    """(chain, row_idx, seq), as the queries number them."""
    count, out = collections.Counter(), []
    for _, text, source, _ in sorted(rows):
        out.append((source, count[source], text.replace(" ", "-")))
        count[source] += 1
    return out


def got(spark, name, at):
    return sorted((tuple(r) for r in registry.QUERIES[name](spark, at).collect()), key=repr)


def test_dedup_sequences_whole(spark, texts):
    first = {}
    for chain, i, seq in sorted(aligned(texts[1]), key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        first.setdefault(seq, (chain, i, seq))
    assert got(spark, "dedup_sequences", texts[0]) == sorted(first.values(), key=repr)


def test_msa_profile_and_empty_columns_whole(spark, texts):
    cells = collections.defaultdict(collections.Counter)
    for chain, _, seq in aligned(texts[1]):
        for col, letter in enumerate(seq):
            cells[chain, col][letter] += 1
    cells = {k: v for k, v in cells.items() if k[0] is not None}
    want = {(*k, x): round(n / sum(c.values()), 6) for k, c in cells.items() for x, n in c.items()}
    assert {tuple(r)[:3]: r.share for r in registry.QUERIES["msa_profile"](spark, texts[0]).collect() if r.letter and r.chain is not None} == pytest.approx(want)
    empty = {tuple(r) for r in registry.QUERIES["empty_columns"](spark, texts[0]).collect() if r.chain is not None}
    assert empty == {k for k, c in cells.items() if set(c) == {"-"}}


def test_row_queries_whole(spark, texts):
    rows = aligned(texts[1])
    lower = lambda s: sum(x.islower() for x in s)
    assert got(spark, "align_columns", texts[0]) == sorted(((c, i, "".join(x for x in s if not x.islower()), lower(s)) for c, i, s in rows), key=repr)
    runs = lambda s: " ".join(str(len(x)) for x in re.split("[^a-z]", s))
    assert got(spark, "scan_a3m", texts[0]) == sorted(((c, i, runs(s)) for c, i, s in rows), key=repr)
    assert got(spark, "deletion_scale", texts[0]) == sorted(((c, i, pytest.approx(math.atan(lower(s) / 3) * 2 / math.pi, abs=1e-6), min(1, lower(s))) for c, i, s in rows), key=lambda r: repr(r[:2]))
    letters = {(r.chain, r.row_idx): r.letters for r in registry.QUERIES["scan_fasta"](spark, texts[0]).collect() if r.chain}
    assert letters == {(c, i): len(s.replace("-", "")) for c, i, s in rows if c and s.replace("-", "")}
    masked = {(r.chain, r.row_idx): r.masked for r in registry.QUERIES["mask_tokens"](spark, texts[0]).collect()}
    total = {(c, i): len(s.replace("-", "")) for c, i, s in rows if c and s}
    assert set(masked) == set(total) and 0.1 < sum(masked.values()) / sum(total.values()) < 0.2 and all(n <= total[k] for k, n in masked.items())


def test_encode_sequence_whole(spark, texts):
    found = {int(r.family_id[:8]): (r.total, r.unknown) for r in registry.QUERIES["encode_sequence"](spark, texts[0]).collect()}
    for i, text, *_ in texts[1]:
        s = text.strip(" ").upper()
        if s:
            assert found[i] == (sum(ALPHABET.find(x) for x in s), sum(x not in ALPHABET for x in s))


@pytest.fixture(scope="module")
def members(spark, tmp_path_factory):
    """Line items: few paths, so that families share them in chains; trajectories of many lengths."""
    rng = random.Random(7)
    rows = [(f, m, rng.randrange(40), rng.randrange(30), rng.choice("NAR"), float(rng.choice([1, 2, 9, 12, 25, 46, 50]))) for f in range(1, 40) for m in range(1, rng.randint(2, 4))]
    at = str(tmp_path_factory.mktemp("members"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string, l_quantity double").repartition(3).write.parquet(f"{at}/lineitem.parquet")
    return at, rows


def union_find(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        return n if root[n] == n else find(root[n])

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_components_whole(spark, members):
    at, rows = members
    by = collections.defaultdict(list)
    for family, _, supp, part, *_ in rows:
        by[supp % 3, part].append(family)
    want = union_find({r[0] for r in rows}, [(fs[0], f) for fs in by.values() for f in fs])
    assert {r.node: r.component for r in registry.QUERIES["components"](spark, at).collect()} == want
    size = collections.Counter(want.values())
    found = {r.component: r for r in registry.QUERIES["component_report"](spark, at).collect()}
    assert {c: r["size"] for c, r in found.items()} == size
    assert all(r.singleton == (size[c] == 1) and r.crosses == (len({n % 3 for n in want if want[n] == c}) > 1) for c, r in found.items())


def test_text_components(spark, texts):
    by, name = collections.defaultdict(list), lambda i, lang: f"{i:08d}_{lang}"
    for i, text, _, lang in texts[1]:
        by[text.strip(" ").upper()].append(name(i, lang))
    want = union_find({name(r[0], r[3]) for r in texts[1]}, [(min(fs), f) for fs in by.values() for f in fs])
    assert {r.node: r.component for r in registry.QUERIES["text_components"](spark, texts[0]).collect()} == want


def test_trajectories_whole(spark, members):
    at, rows = members
    tracks = [(f, m, int(q * 100)) for f, m, _, _, flag, q in rows if flag == "N"]
    windows = lambda width: [(f, m, step, start) for f, m, n in tracks for step in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512) for start in range(0, n - (width - 1) * step, 50)]
    slots = [(f, m, x) for f, m, n in tracks for x in range(0, n, 50)] + [(f, m, None) for f, m, _, _, flag, _ in rows if flag != "N"]
    assert got(spark, "iid_slots", at) == sorted(slots, key=repr)
    pairs = collections.defaultdict(list)
    for f, m, step, start in windows(2):
        pairs[f, m, step].append(start)
    assert {tuple(r)[:3]: (r.n, r.starts) for r in registry.QUERIES["forward_pairs"](spark, at).collect()} == {k: (len(v), sum(v)) for k, v in pairs.items()}
    nine = windows(9)
    assert got(spark, "trajectory_windows_whole", at) == sorted(((f, m, step, s, " ".join(str(s + k * step) for k in range(9))) for f, m, step, s in nine), key=repr)
    turned = {tuple(r)[:4]: r for r in registry.QUERIES["orient_window_whole"](spark, at).collect()}
    assert set(turned) == set(nine) and any(r.reversed for r in turned.values())
    for (_, _, step, s), r in turned.items():
        ends = (s, s + 8 * step)
        assert (r.source_frame, r.target_frame) == (ends[::-1] if r.reversed else ends) and (not r.reversed or s >= 1000 and step <= 64)
    gate = collections.Counter(f for f, _, step, s in nine if s >= 1000 and step <= 64)
    assert {r.family_id: r.n for r in registry.QUERIES["reversal_gate"](spark, at).collect()} == gate


def test_msa_unpaired(spark, texts):
    rows = aligned(texts[1])
    chains = collections.defaultdict(set)
    for c, _, s in rows:
        chains[s].add(c)
    assert got(spark, "msa_unpaired_anti", texts[0]) == sorted(((c, i) for c, i, s in rows if len(chains[s]) == 1), key=repr)


def test_pairing_and_centers(spark):
    """By hand: ranks follow the likeness to a chain's first row, species in one chain or too large are left out, gaps don't attract."""
    rows = [("A", "", 0, "ACDE"), ("A", "x", 1, "AAAA"), ("A", "x", 2, "ACDA"), ("A", "y", 3, "ACDE"), ("B", "", 0, "WW"), ("B", "x", 1, "WW"), ("B", "x", 2, "W"), ("B", "x", 3, "AA"), ("C", "z", 0, "K")]
    msa = spark.createDataFrame(rows, "chain string, species string, row_idx int, seq string")
    pairs = {(r.species, r["rank"], r.chain): r.row_idx for r in A.pair_by_species(msa).collect()}
    assert pairs == {("x", 1, "A"): 2, ("x", 2, "A"): 1, ("x", 1, "B"): 1, ("x", 2, "B"): 2}
    assert A.pair_by_species(msa, most=2).count() == 0
    centers = spark.createDataFrame([("A", 0, "----A"), ("A", 1, "B---C"), ("A", 2, "B---C")], "chain string, row_idx int, seq string")
    near = spark.createDataFrame([("A", 8, "----C"), ("A", 9, "----"), ("A", 10, "B--A")], "chain string, row_idx int, seq string")
    assert {r.row_idx: (r.center, r.agreement) for r in A.agreement(near, centers, gaps=False).collect()} == {8: (1, 1), 9: (0, 0), 10: (1, 1)}


def test_corrected_definitions(spark):
    """Small cases by hand."""
    one = spark.range(1)
    near = lambda *a: one.select(W.nonoverlap_starts(*[F.lit(x).cast("int") if i != 2 else x for i, x in enumerate(a)]).alias("s")).first().s
    grid = lambda *a, stride=4: one.select(W.emitted_starts(*[F.lit(x).cast("int") if i != 2 else x for i, x in enumerate(a)], stride).alias("s")).first().s
    assert near(20, 2, 5, 0, None) == [0, 8] and near(17, 2, 5, 0, None) == [0, 8] and near(16, 2, 5, 0, None) == [0] and near(8, 2, 5, 0, None) == [] and near(20, 2, 5, 1, 9) == [1]
    assert grid(20, 2, 5, 3, None) == [4, 8] and grid(20, 2, 5, 3, 8) == [4] and grid(20, 2, 5, 13, None) == []
    gate = lambda start, step, **k: one.select(W.may_reverse(F.lit(start), F.lit(step), **k).alias("x")).first().x
    assert gate(1000, 64) and not gate(999, 64) and not gate(1000, 65) and not gate(1000, 64, prob=0.0)
    status = lambda *a: one.select(E.validity(*[F.lit(x).cast("double") for x in a]).alias("x")).first().x
    assert [status(0.25, 0, 0, 0), status(0.06, 0, 0.01, 0), status(0.06, 0, 0.0, 0), status(0.0, 0.5, 0, 0.495), status(0.0, 0.9, 0, 0.0)] == ["void", "ok", "flagged", "ok", "flagged"]
    lines = spark.createDataFrame([("r", i, s) for i, s in enumerate([1, 2, 3, 4, 3, 5, 5, 6, 2])], "run string, line_no long, step long")
    for chunk in (2, 3, 100):
        W.CHUNK = chunk
        assert sorted((r.line_no, r.step) for r in W.superseded(lines, "run", "line_no", "step").collect()) == [(0, 1), (8, 2)]
        assert sorted(r.line_no for r in W.superseded(lines.where("line_no < 8"), "run", "line_no", "step").collect()) == [0, 1, 4, 6, 7]
    W.CHUNK = 10_000
    ids = spark.createDataFrame([("120", "1abc_A", ""), ("90", "", "x1"), ("7", None, None)], "seqlen string, chain_id string, name string")
    assert {r.id for r in T.id_list(ids).collect()} == {"1abc_A", "x1"}


@pytest.mark.parametrize("sizes", [[1, 1, 1], [5], [3] * 40 + [9, 30], [2, 50, 50, 60] * 9, list(range(1, 60))])
def test_share_cap_scans_up(spark, sizes):
    want = None
    for cap in range(1, max(sizes) + 1):
        draws = sum(min(n, cap) for n in sizes)
        if cap > draws * 0.08:
            break
        want = (cap, draws)
    found = S.share_cap(spark.createDataFrame([(n,) for n in sizes], "size long"), "size", 0.08).first()
    assert tuple(found) == (want or (1, None))


def test_effective_dim_is_of_the_whole_spectrum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 30, 12)) * np.arange(1, 13)
    rows = [(e, f, r, *map(float, x[e, f, 3 * r : 3 * r + 3])) for e in range(2) for f in range(30) for r in range(4)]
    frames = spark.createDataFrame(rows, "ensemble_id long, frame_idx long, res_idx int, x double, y double, z double").repartition(5)
    spectra = [np.linalg.eigvalsh(np.cov(v.T)) for v in x]
    assert {r.ensemble_id: r.dim for r in E.effective_dim(frames).collect()} == pytest.approx({e: s.sum() ** 2 / (s**2).sum() for e, s in enumerate(spectra)})


def test_seeded_shuffle_ranks_by_ranges(spark, texts):
    df = registry.QUERIES["seeded_shuffle"](spark, texts[0])
    want = sorted((f"{i:08d}_{lang}" for i, _, _, lang in texts[1]), key=lambda x: (hashlib.sha256(f"5\0{x}".encode()).hexdigest()[:12], x))
    assert [r.family_id for r in sorted(df.collect(), key=lambda r: r.place)] == want
    assert "row_number" not in df._jdf.queryExecution().toString()


def test_residue_index_totals(spark):
    """Equal to the sums of residue_indices(); a row of very many letters takes one pass."""
    import time

    from ensemblespark.functions import expressions as X

    rows = spark.createDataFrame([("aB-C",), ("-",), ("abc",), ("XÄß-𝔸z",)], "s string")
    for r in rows.select(X.residue_indices(F.col("s"), F.lit(3)).alias("at"), X.residue_index_totals(F.col("s"), F.lit(3)).alias("t")).collect():
        assert (r.t.gaps, r.t.residues, r.t.places) == (sum(x < 0 for x in r.at), sum(x >= 0 for x in r.at), sum(x for x in r.at if x >= 0))
    n = 200_000
    start = time.time()
    t = spark.createDataFrame([("A-" * n,)], "s string").select(X.residue_index_totals(F.col("s"), F.lit(3)).alias("t")).first().t
    assert (t.gaps, t.residues, t.places) == (n, n, 3 * n + n * (n - 1) // 2) and time.time() - start < 60


def test_window_faults_equal_violations(spark):
    """Faults by arithmetic are those found in the arrays of frames."""
    rows = spark.createDataFrame([(0, 1, 2, 0, 2), (5, 5, 7, 5, 7), (1, 2, 1, 2, 9), (3, 4, 5, 3, 4)], "a int, b int, c int, s int, t int")
    frames = [F.col(x) for x in "abc"]
    faults = W.window_faults(frames, F.col("s"), F.col("t"))
    got = rows.select(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in faults.items()])).alias("f"), W.window_violations(F.array(*frames), F.col("s"), F.col("t")).alias("v")).collect()
    assert [sorted(r.f) for r in got] == [sorted(r.v) for r in got] == [[], ["repeat"], ["repeat", "source", "target"], ["target"]]


def test_windows_are_spread_before_they_are_made(spark):
    """Members from one partition become windows in many tasks."""
    members = spark.createDataFrame([(i, 1, True, 500) for i in range(200)], "family_id long, member_id int, is_trajectory boolean, n_frames int").coalesce(1)
    for made in (W.windows(members, [1, 2], 50, 3), W.window_ends(members, [1, 2], 50, 3)):
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_homology_pairs_of_repeated_sequences(spark, monkeypatch):
    """Sequences that many families share give every pair of these once, across and within blocks of ids."""
    from ensemblespark.operators import identity as I

    monkeypatch.setattr(I, "BLOCK", 3)
    names = ["RED SMALL WIDGET", "BLUE SMALL WIDGET", "TINY ANVIL", "LONELY THING"]
    rows = [(i, names[i % 3]) for i in range(31)] + [(99, names[3])]
    got = [(r.a, r.b) for r in I.homology_pairs(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()]
    grams = lambda s: {s[i : i + 8] for i in range(len(s) - 7)}
    alike = lambda s, t: 2 * len(grams(s) & grams(t)) >= min(len(grams(s)), len(grams(t)))
    assert sorted(got) == sorted((a, b) for a, s in rows for b, t in rows if a < b and alike(s, t))


def test_contained_pairs_by_few_runs(spark):
    """Every text that is part of another is found, from a fraction of the runs."""
    import pyarrow as pa

    from ensemblespark.operators import identity as I

    rng = random.Random(5)
    long_ = ["".join(rng.choices("abcdé ", k=400)) for _ in range(12)]
    parts = [t[(at := rng.randrange(300)) : at + rng.randrange(20, 90)] for t in long_ for _ in range(4)]
    texts = list(dict.fromkeys([*long_, *parts, "a" * 25, "b" + "a" * 40, "short"]))
    got = {(r.short, r.long) for r in I.contained_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, s string")).collect()}
    assert got == {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if len(s) >= 20 and len(s) < len(t) and s in t}
    made = list(I._kmer_hashes(13)([pa.RecordBatch.from_pydict({"id": list(range(12)), "s": long_})]))
    assert 5 * sum(b.num_rows for b in made) < sum(len(t) for t in long_)


def test_frame_distances_in_few_large_blocks(spark, monkeypatch):
    """An ensemble has no more than BLOCKS blocks, so what is dealt out grows with its frames; sums stay the same."""
    monkeypatch.setattr(E, "FRAMES", 4)
    monkeypatch.setattr(E, "BLOCKS", 2)
    x = np.random.default_rng(3).normal(size=(41, 6))
    rows = spark.createDataFrame([(1, i, v.tolist(), "all") for i, v in enumerate(x)], "ensemble_id int, frame_idx int, v array<double>, label string")
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2) / 2).sum(1)
    got = {r.frame_idx: (r.total, r.n) for r in E.frame_distances(rows).collect()}
    assert all(abs(got[i][0] - want[i]) < 1e-6 and got[i][1] == 41 for i in range(41))


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    from ensemblespark.operators import components as K

    monkeypatch.setattr(K, "HUB", 5)
    edges = spark.createDataFrame([(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(50, 90)] + [(60, i) for i in range(100, 120)] + [(200, 201), (201, 202)], "u long, v long")
    got = {r.node: r.component for r in K.components(edges).collect()}
    assert got == {i: 0 for i in range(40)} | {i: 50 for i in [*range(50, 91), *range(100, 120)]} | {i: 200 for i in range(200, 203)}
    beside, least = K._beside_least(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    assert {r.u for r in least.where(F.col("n") > K.HUB).collect()} == {0, 60}
    assert sorted((r.u, r.v, r.m) for r in beside.collect()) == sorted((r.u, r.v, r.m) for r in edges.join(least, "u").collect())


def test_encode_sequence_equals_sql_on_odd_texts(spark, tmp_path):
    """Empty texts have a row of zeros, other spaces than the plain one are taken off the ends, a missing language leaves its name out."""
    import duckdb

    rows = [(0, "", "en"), (1, "   ", "en"), (2, "\u00a0ACxD\u3000", "en"), (3, None, "en"), (4, "wy \u00a0 Wé", None), (5, "\tAC\n", "de"), (6, "\U0001f600A\u2003", "de"), (7, "\u00a0", None), (123456789, "AC", "en")]
    spark.createDataFrame([(i, t, "s", lang) for i, t, lang in rows], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = got(spark, "encode_sequence", str(tmp_path))
    assert found == sorted(con.execute(registry.SQL["encode_sequence"]).fetchall(), key=repr)
    assert ("00000000_en", 0, 0) in found and ("00000002_en", 2, 1) in found and ("00000007_", 0, 0) in found


def test_windows_are_made_once_a_length(spark, members, monkeypatch):
    """Windows joined by their trajectory's length are those that each trajectory makes; many lengths are not broadcast."""
    found = {}
    for shared in (500_000, 0):
        monkeypatch.setattr(W, "SHARED", shared)
        found[shared] = [got(spark, name, members[0]) for name in ("trajectory_windows_whole", "orient_window_whole")]
        plan = registry.QUERIES["orient_window_whole"](spark, members[0])._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == bool(shared)
    assert found[0] == found[500_000] and len(found[0][0]) == len(found[0][1]) > 1000
    rows = spark.createDataFrame([(7, 3, 1000 + 50 * i, 2, 1016 + 50 * i) for i in range(40)], "family_id long, member_id int, start int, step int, last int")
    for r in W.oriented_ends(rows, 3, 0.5, 1000, 64).collect():
        start = r.target_frame if r.reversed else r.source_frame
        assert r.reversed == (int(hashlib.sha256(f"3|7|3|{start}|2".encode()).hexdigest()[:16], 16) < 2**63)


def test_homology_pairs_leave_in_parts(spark, monkeypatch):
    """Pairs of blocks of ids become pairs of ids a bounded number at a time, whatever the ids' type."""
    import pyarrow as pa

    from ensemblespark.operators import identity as I

    monkeypatch.setattr(I, "RUNS", 50)
    ids = [f"p{i:02d}" for i in range(30)]
    rows = {"ia": [ids[:20], ids[20:]], "ib": [ids[:20], ids[:20]], "same": [True, False], "shared": [3, 4], "containment": [0.5, 1.0], "substring": [False, True]}
    made = list(I._crossed([pa.RecordBatch.from_pydict(rows)]))
    assert max(b.num_rows for b in made) <= 50 and len(made) > 5
    got = sorted(tuple(r.values()) for b in made for r in b.to_pylist())
    assert got == sorted([(a, b, 3, 0.5, False) for a in ids[:20] for b in ids[:20] if a < b] + [(b, a, 4, 1.0, True) for a in ids[20:] for b in ids[:20]])
    frame = spark.createDataFrame([(f"x{i}", "SAME LONG NAME") for i in range(9)], "id string, s string")
    assert I.homology_pairs(frame, "id", "s").count() == 36


def test_contained_pairs_meet_in_parts(spark, monkeypatch, tmp_path):
    """Runs meet a part at a time and texts are dealt out only for candidates; pairs are those of the SQL, copies under their least id."""
    import duckdb

    from ensemblespark.operators import identity as I

    rng = random.Random(6)
    long_ = ["".join(rng.choices("ABCDEFGH ", k=300)).strip(" ") for _ in range(15)]
    texts = [*long_, *(t[30:90].strip(" ") for t in long_[:6]), long_[3], long_[0][30:90].strip(" "), "", "SHORT"]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    monkeypatch.setattr(I, "MET", 100)
    parts, keep = [], I.keep
    monkeypatch.setattr(I, "keep", lambda df: parts.append(df.columns) or keep(df))
    found = got(spark, "contained_pairs", str(tmp_path))
    assert found == sorted(con.execute(registry.SQL["contained_pairs"]).fetchall()) and len(found) >= 6
    assert parts.count(["id", "r"]) > 3
