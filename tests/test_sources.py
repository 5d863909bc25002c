"""Text formats from small files."""

from pyspark.sql import functions as F

from ensemblespark.sources import text as T


def lines(spark, *rows):
    return spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, line_no int, line string")


def test_catalog_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"families": [{"family_id": "a", "seqres": "AC", "members": [{"member_id": "m2", "pdb_path": "x/1.pdb"}, {"member_id": "m1", "xtc_path": "/abs/1.xtc", "n_frames": 3}]}]}')
    rows = T.read_catalog(spark, str(tmp_path / "c.json"))
    got = {r.member_id: r for r in rows.collect()}
    assert got["m1"].xtc_path == "/abs/1.xtc" and got["m1"].n_frames == 3
    assert got["m2"].pdb_path.endswith("/x/1.pdb") and got["m2"].pdb_path.startswith("file:")
    assert [m.member_id for m in T.nest_catalog(rows).first().members] == ["m1", "m2"]


def test_fasta_and_a3m(spark):
    t = spark.createDataFrame([("#c\n>one x\nACab\nD-\n\n>two\nAcCD\n",)], "text string")
    r = T.a3m_rows(T.fasta_records(t, "text")).orderBy("place").collect()
    assert [(x.header, x.sequence, x.aligned, list(x.deletions)) for x in r] == [("one x", "ACabD-", "ACD-", [0, 0, 2, 0]), ("two", "AcCD", "ACD", [0, 1, 0])]


def test_stockholm(spark):
    r = T.stockholm_rows(lines(spark, "# STOCKHOLM 1.0", "a AC-", "b ACD", "", "a GG", "b -G", "//")).orderBy("first").collect()
    assert [(x.name, x.sequence) for x in r] == [("a", "AC-GG"), ("b", "ACD-G")]


def test_pdb_atoms_and_lines(spark):
    atom = "ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00  5.50           C  "
    got = T.pdb_atoms(lines(spark, "MODEL 1", atom, "ENDMDL", "MODEL 2", atom.replace("11.104", "12.000"), "TER")).orderBy("model").collect()
    assert [(r.model, r.atom, r.resname, r.chain, r.resseq, r.x, r.bfactor) for r in got] == [(1, "CA", "ALA", "A", 1, 11.104, 5.5), (2, "CA", "ALA", "A", 1, 12.0, 5.5)]
    atoms = spark.createDataFrame([("f", "m", "CA", "ALA", 1, 11.104, 6.134, -6.504, 5.5), ("f", "m", "CB", "ALA", 1, None, 0.0, 0.0, None)], "family_id string, member_id string, atom string, resname string, resseq int, x double, y double, z double, bfactor double")
    assert [r.line for r in T.pdb_lines(atoms).collect()] == [atom]


def test_cluster_lines_and_ids(spark):
    got = T.cluster_lines(lines(spark, "b_1  a_1", "", "c_2")).collect()
    assert sorted((r.cluster_id, r.token) for r in got) == [("a_1", "a_1"), ("a_1", "b_1"), ("c_2", "c_2")]
    ids = T.id_list(spark.createDataFrame([("", "x"), ("y", "z"), ("#no", "")], "family_id string, pdb_id string"))
    assert sorted(r.id for r in ids.collect()) == ["x", "y"]


def test_run_log_and_checkpoints(spark):
    log = lines(spark, "[step 5] samples=40 lr=0.1 train_loss(mean over 3)=0.5\r[val] epoch=1 step=5 val_loss=0.25", "noise", "[step 6] samples=48 train_loss=0.4")
    r = T.run_log(log, "file", "line_no", "line").orderBy("line_no", "part").collect()
    assert [(x.kind, x.step, x.samples, x.loss) for x in r] == [("train", 5, 40, 0.5), ("val", 5, None, 0.25), ("train", 6, 48, 0.4)]
    names = spark.createDataFrame([("a-epoch3-step40.ckpt",), ("a-epoch3-end.ckpt",), ("a-bestfwd-step9.ckpt",), ("a-stopped-step7.ckpt",), ("last.ckpt",), ("a_b-epoch1-end.ckpt",)], "n string")
    want = [("a", "epoch_step", 3, 40), ("a", "epoch_end", 3, None), ("a", "bestfwd", None, 9), ("a", "stopped", None, 7), (None, None, None, None), (None, None, None, None)]
    assert [tuple(r) for r in names.select(*T.checkpoint_name(F.col("n"))).collect()] == want


def test_stockholm_leaves_out_the_query_s_gaps(spark):
    """The first row has a gap in its second and fourth places; what others have there are deletions before the next place."""
    lines = ["# STOCKHOLM 1.0", "q A-C", "x AbC", "y ---", "", "q -D", "x eD", "y fD", "//"]
    rows = T.stockholm_rows(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    got = {r.name: (r.aligned, r.deletions) for r in T.without_query_gaps(rows).collect()}
    assert got == {"q": ("ACD", [0, 0, 0]), "x": ("ACD", [0, 1, 1]), "y": ("--D", [0, 0, 1])}


def test_plain_lists_and_case_faults(spark):
    import pytest

    text = spark.createDataFrame([("1abc_A  # seen",), ("# all",), ("",), ("  2xyz\t0.5",), ("1abc_A",)], "value string")
    assert sorted(r.id for r in T.id_lines(text).collect()) == ["1abc_A", "2xyz"]
    with pytest.raises(ValueError, match="empty"):
        T.id_lines(text.where("value = '' or value = '# all'"))
    cases = spark.createDataFrame([("d", "a", 0), ("d", "a", 1), ("d", "b", 0), ("d", "b", 0), ("e", None, 0)], "dataset string, case_id string, rep int")
    wanted = spark.createDataFrame([("a",), ("z",)], "case_id string")
    assert {tuple(r) for r in T.case_faults(cases, wanted).collect()} == {("d", "b", 0, "repeated"), ("e", None, 0, "no id"), (None, "z", None, "unknown")}


def test_rolling_mean_steps_over_holes(spark):
    from ensemblespark.operators.windows import adaptive_mean

    rows = [("r", i, float(i) if i % 3 else None) for i in range(900)] + [("s", 0, None), ("s", 1, 1.0)]
    got = {(r.g, r.i): (r.window, r.mean) for r in adaptive_mean(spark.createDataFrame(rows, "g string, i int, v double"), "g", "i", "v").collect()}
    for g, i, _ in rows:
        k = 22 if g == "r" else 10
        seen = [v for h, j, v in rows if h == g and i - k < j <= i and v is not None]
        assert got[g, i] == (k, None if not seen else pytest_approx(sum(seen) / len(seen)))


def pytest_approx(x):
    import pytest

    return pytest.approx(x)


def test_stockholm_rows_of_great_length(spark):
    """The work of a row grows with its letters, not with their square."""
    import time

    n = 200_000
    rows = spark.createDataFrame([("q", 0, "AB-" * (n // 3)), ("r", 1, "A-x" * (n // 3) + "TAIL")], "name string, first int, sequence string")
    start = time.time()
    got = {r.name: r for r in T.without_query_gaps(rows).collect()}
    assert time.time() - start < 60
    assert got["r"].aligned == "A-" * (n // 3) + "TAIL" and sum(got["r"].deletions) == n // 3 and len(got["r"].deletions) == len(got["r"].aligned)
    assert got["q"].aligned == "AB" * (n // 3) and sum(got["q"].deletions) == 0
