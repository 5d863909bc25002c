"""Streams replayed from files."""

from pyspark.sql import functions as F

from ensemblespark.streaming import runs


def _replayed(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_best_so_far(spark, tmp_path):
    (tmp_path / "a.log").write_text("[val] epoch=0 step=1 val_loss=0.5\n[val] epoch=0 step=2 val_loss=0.4\n[step 3] samples=1 train_loss=1.0\n")
    (tmp_path / "b.log").write_text("[val] epoch=0 step=7 val_loss=0.9\r[val] epoch=0 step=8 val_loss=1.9\n")
    got = _replayed(spark, runs.best_so_far(runs.log_stream(spark, str(tmp_path))), "best", "complete")
    assert sorted((r.run, r.loss, r.step) for r in got.collect()) == [("a.log", 0.4, 2), ("b.log", 0.9, 7)]


def test_activity_replays_like_batch(spark):
    at = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(at)
    stream = spark.readStream.schema(batch.schema).parquet(at.replace("events.parquet", "event*.parquet"))
    got = _replayed(spark, runs.activity(stream), "act", "complete")
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "5 minutes", "1 minute"), "event_type").agg(F.count("*").alias("n"))
    assert sorted((str(r.window), r.event_type, r.n) for r in got.collect()) == sorted((str(r.window), r.event_type, r.n) for r in want.collect())


def test_latest_status_and_budget(spark):
    rows = spark.createDataFrame([("u", 1, "failed"), ("u", 2, "ok"), ("v", 5, "failed")], "unit string, seq int, status string")
    assert sorted(tuple(r) for r in runs.latest_status(rows).collect()) == [("u", 2, "ok"), ("v", 5, "failed")]
    fails = spark.createDataFrame([("f", "m"), ("f", "m"), ("g", "m")], "family_id string, member_id string")
    assert runs.over_budget(fails, 1).first().n == 2 and runs.over_budget(fails, 2).first() is None


def chunk(path, name, *lines):
    import json

    (path / "in").mkdir(exist_ok=True)
    (path / "in" / name).write_text("".join(json.dumps({"run": r, "line_no": n, "line": x}) + "\n" for r, n, x in lines))


def test_growing_logs_resume_after_a_restart(spark, tmp_path):
    step = lambda n: f"[step {n}] samples={n} train_loss=0.5"
    at = str(tmp_path / "state")
    go = lambda: sorted((r.run, r.line_no, r.step) for r in runs.resumed(runs.chunk_stream(spark, str(tmp_path / "in")), at).collect())
    chunk(tmp_path, "1.json", ("a", 0, step(1)), ("a", 1, step(2)), ("a", 2, step(3)), ("b", 0, step(9)))
    assert go() == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 9)]
    chunk(tmp_path, "2.json", ("a", 3, step(2)), ("a", 4, step(3)))  # the log of a goes on from step 2; a new query, nothing in memory
    assert go() == [("a", 0, 1), ("a", 3, 2), ("a", 4, 3), ("b", 0, 9)]
    chunk(tmp_path, "3.json", ("b", 1, step(10)), ("c", 0, step(1)))
    want = [("a", 0, 1), ("a", 3, 2), ("a", 4, 3), ("b", 0, 9), ("b", 1, 10), ("c", 0, 1)]
    assert go() == want and go() == want
    # A batch that was cut off before its runs were listed is run again and gives the same.
    import shutil

    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state" / "runs").iterdir() if "=" in p.name)
    shutil.rmtree(tmp_path / "state" / "runs" / f"batch={last}")
    commits = tmp_path / "state" / "checkpoint" / "commits"
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    assert go() == want


def test_stalls_by_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = tmp_path / "events"
        folder.mkdir()
        stamp = lambda m: f"2024-01-01 {10 + m // 60:02}:{m % 60:02}:00"
        write = lambda name, *rows: (folder / name).write_text("".join(f"{k},{stamp(m)}\n" for k, m in rows))
        stream = runs.stalls(spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).csv(str(folder)), "10 minutes", "1 minute")
        go = lambda: runs.replay_on(stream, str(tmp_path / "state"))
        write("1.csv", ("a", 0), ("b", 1), ("c", 2))
        write("2.csv", ("a", 5), ("b", 9))
        assert go() == []
        write("3.csv", ("a", 14), ("b", 15))  # c, last seen at 2, is 10 minutes behind the watermark
        first = go()
        write("4.csv", ("b", 30), ("c", 31))  # a stopped at 14; c came back
        write("5.csv", ("b", 40), ("b", 60))
        both = go()
        seen = sorted((r.key, (r.last // 1000 - 1704103200) // 60) for r in both)
        assert ("c", 2) in seen and ("a", 14) in seen and ("c", 31) in seen and all(k != "b" or m < 60 for k, m in seen) and len(first) <= len(both)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_lines_are_numbered_by_their_place(spark):
    """Gaps in the logger's numbers don't show: a run's lines count from 0."""
    rows = spark.createDataFrame([("a", 7, 1), ("a", 40, 2), ("a", 3_000_000_000, 3), ("b", 5, 4)], "run string, line_no long, step long")
    assert sorted((r.run, r.line_no, r.step) for r in runs.numbered(rows).collect()) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 4)]
