"""Streams of run logs and progress: the same parsing and rules as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import ranked
from ..operators.windows import superseded
from ..sources.text import run_log


def log_stream(spark: SparkSession, folder: str, name: str = r"([^/]+)$") -> DataFrame:
    """Typed rows of run logs as files appear in a folder, with their line's number in the file from 0; the run
    is what `name` finds in the file's path, the file's own name by default."""
    files = spark.readStream.text(folder, wholetext=True)
    lines = files.select(F.regexp_extract(F.input_file_name(), name, 1).alias("run"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return run_log(lines, "run", "line_no", "line").drop("part")


def chunk_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Typed rows of run logs that grow, written in chunks: JSON lines of (run, line_no, line), as many files as the
    logger likes. A log that goes on is read on from its new chunks; no log is ever one row or one task."""
    lines = spark.readStream.schema("run string, line_no long, line string").json(folder)
    return run_log(lines, "run", "line_no", "line").drop("part")


def new_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size) of files as they appear in a folder or below it; their content isn't read."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"))


def replay(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """All that a stream has now, run to its end: the rows appended, or in complete mode the last result.
    Results and checkpoints lie under path, in a folder that all executors share."""
    def save(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={i if mode == 'append' else 0}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/out/none")  # for a stream without data
    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


def numbered(rows: DataFrame) -> DataFrame:
    """Log rows (run, line_no, ...) with line_no their place in their run from 0, whatever numbers the logger gave; no task sorts a whole run."""
    return ranked(rows, ["run"], ["line_no"], "_place").withColumn("line_no", (F.col("_place") - 1).cast("int")).drop("_place")


def replay_on(stream: DataFrame, path: str) -> list:
    """The rows that a stream has given so far under path, after reading what is new now; it goes on from its checkpoint."""
    def save(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={i}")

    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/out/none")
    q = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*").collect()


def resumed(stream: DataFrame, path: str) -> DataFrame:
    """A stream of log rows (run, line_no, step, ...) without those that a later line of their run replaces.

    A batch merges its rows with what is kept of the runs it has, and of no others, and writes these runs under its
    own number; a run's state is what the last batch that had it wrote. All of that is in the folder: after
    a restart with the same path the stream goes on where it stopped, and a batch that is repeated
    writes the same once more. The list of a batch's runs is written last and makes it count."""
    spark, schema = stream.sparkSession, stream.schema

    def kept(below: int | None) -> DataFrame:
        batches = lambda name, columns: spark.read.schema(f"{columns}, batch int").parquet(f"{path}/{name}")
        named = batches("runs", "run string")
        last = (named if below is None else named.where(F.col("batch") < below)).groupBy("run").agg(F.max("batch").alias("batch"))
        return batches("kept", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)).join(last, ["run", "batch"]).select(*schema.names)

    def merge(batch: DataFrame, i: int) -> None:
        mine = batch.select("run").distinct()
        rows = batch.unionByName(kept(i).join(mine, "run", "left_semi"))
        superseded(rows, "run", "line_no", "step").write.mode("overwrite").parquet(f"{path}/kept/batch={i}")
        mine.write.mode("overwrite").parquet(f"{path}/runs/batch={i}")

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/kept/batch=-1")
    spark.createDataFrame([], "run string").write.mode("ignore").parquet(f"{path}/runs/batch=-1")
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(merge).start()
    q.awaitTermination()
    return kept(None)


def stalls(events: DataFrame, patience: str, late: str) -> DataFrame:
    """(key, last): a row for each time that nothing came from a key (key, ts) for `patience` of event time.

    The key's newest time is its state, and a timer stands `patience` after it; every newer row moves both. The timer
    fires once the watermark, `late` behind the newest time of all keys, has passed it: no comparison
    after the end, and a key that comes back and stops again is reported again. Needs a state store with timers
    (spark.sql.streaming.stateStore.providerClass: RocksDBStateStoreProvider)."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    wait = int(events.sparkSession.sql(f"select cast(timestamp '1970-01-01 00:00:00' + interval {patience} as double) - cast(timestamp '1970-01-01 00:00:00' as double) as s").first().s * 1000)

    class Watch(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long")

        def handleInputRows(self, key, rows, timerValues):
            newest = max(r.ms for r in rows)
            before = self.last.get()[0] if self.last.exists() else None
            if before is None or newest > before:
                if before is not None:
                    self.handle.deleteTimer(before + wait)
                self.handle.registerTimer(newest + wait)
                self.last.update((newest,))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            from pyspark.sql import Row

            at = self.last.get()[0]
            self.last.clear()
            yield Row(key=key[0], last=at)

        def close(self) -> None:
            pass

    own = events.select("key", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return own.groupBy("key").transformWithState(statefulProcessor=Watch(), outputStructType="key string, last long", outputMode="append", timeMode="EventTime")


def last_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last place of each key so far (for update or complete mode)."""
    return rows.groupBy(key).agg(F.max(order).alias("last"))


def stalled(seen: DataFrame, key: str, patience: int) -> DataFrame:
    """Keys whose last place is more than `patience` behind the farthest of all."""
    top = seen.agg(F.max("last").alias("top"))
    return seen.crossJoin(F.broadcast(top)).where(F.col("top") - F.col("last") > patience).select(key, "last")  # one row


def failing(failures: DataFrame) -> DataFrame:
    """Number of distinct failing (family_id, member_id) pairs so far (for complete mode)."""
    return failures.select("family_id", "member_id").dropDuplicates().groupBy().agg(F.count("*").alias("n"))


def heartbeat(rows: DataFrame, steps: int) -> DataFrame:
    """Mean loss and rows of every window of steps of a run (for update mode)."""
    return rows.where("kind = 'train'").groupBy("run", F.floor(F.col("step") / steps).alias("win")).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def best_so_far(rows: DataFrame) -> DataFrame:
    """Best validation loss of each run so far, with its step (for update or complete mode)."""
    best = F.min(F.struct("loss", "step"))
    return rows.where("kind = 'val'").groupBy("run").agg(best.alias("b")).select("run", "b.loss", "b.step")


def activity(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding event-time windows over events (ts, event_type, value) with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


def latest_status(progress: DataFrame) -> DataFrame:
    """Latest record of each unit by its sequence number (for update or complete mode)."""
    return progress.groupBy("unit").agg(F.max(F.struct("seq", "status")).alias("s")).select("unit", "s.seq", "s.status")


def over_budget(failures: DataFrame, limit: int) -> DataFrame:
    """Number of distinct failing (family, member) pairs in a batch, if beyond the limit."""
    return failures.select("family_id", "member_id").distinct().agg(F.count("*").alias("n")).where(F.col("n") > limit)
