"""Queries that write the given tables as files to the shared folder and run streams over them to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..streaming import runs
from .catalogs import rounded
from .logs import ROWS
from .views import oracle, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: list[str], sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(views, sql) if views else sql
        return f

    return register


def logs(spark, d) -> str:
    """A folder with a log file for each run, its lines in order."""
    path = sinks.own_folder(spark, "logs")
    own = view(spark, d, "log_v").where("line is not null").repartition("run").sortWithinPartitions("run", "line_no")
    own.select("run", F.col("line").alias("value")).write.partitionBy("run").text(path)
    return path


def _stream(spark, d):
    """The logs as a stream of chunks, as loggers append them: a run's lines lie in many files, none of which is a task's only one."""
    path = sinks.own_folder(spark, "chunks")
    view(spark, d, "log_v").where("line is not null").select("run", "line_no", "line").write.json(path)
    return runs.chunk_stream(spark, path)


PLACED = ROWS.replace("from log_v)", "from log_v where line is not null)") + ", q as (select *, line_no as place from r)"


NUMBERED = PLACED.replace("line_no as place from r)", "cast(row_number() over (partition by run order by line_no) - 1 as int) as place from r)")


@query("stream_run_log", ["log_v"], NUMBERED + " select run, place as line_no, step, kind, round(loss, 4) as loss from q")
def stream_run_log(spark, d):
    """A run's lines as the stream gave them, numbered from 0 by their place in the run's log."""
    rows = runs.replay(_stream(spark, d), "append", sinks.own_folder(spark, "stream"))
    return runs.numbered(rows).select("run", "line_no", "step", "kind", F.round("loss", 4).alias("loss"))


@query("stream_best", ["log_v"], PLACED + " select run, round(loss, 4) as loss, step from (select *, row_number() over (partition by run order by loss, step) as rn from q where kind = 'val') where rn = 1")
def stream_best(spark, d):
    return rounded(runs.replay(runs.best_so_far(_stream(spark, d)), "complete", sinks.own_folder(spark, "stream")), "loss", digits=4)


@query("stream_heartbeat", ["log_v"], PLACED + " select run, step // 100 as win, round(avg(loss), 6) as loss, count(*) as n from q where kind = 'train' group by run, step // 100")
def stream_heartbeat(spark, d):
    return rounded(runs.replay(runs.heartbeat(_stream(spark, d), 100), "complete", sinks.own_folder(spark, "stream")), "loss")


@query("stream_resume", ["log_v"], PLACED + " select run, place as line_no, step, kind from (select *, min(step) over (partition by run order by place rows between 1 following and unbounded following) as n from q) where n is null or step < n")
def stream_resume(spark, d):
    return runs.resumed(_stream(spark, d), sinks.own_folder(spark, "stream")).select("run", "line_no", "step", "kind")


@query("stream_stall", ["log_v"], PLACED + ", s as (select run, max(place) as last from q group by run) select run, last from s where (select max(last) from s) - last > 1")
def stream_stall(spark, d):
    """Runs that are more than one line behind the farthest."""
    return runs.stalled(runs.replay(runs.last_seen(_stream(spark, d), "run", "line_no"), "complete", sinks.own_folder(spark, "stream")), "run", 1)


@query("stream_stall_timer", [], "with l as (select user_id, max(cast(ts as timestamp)) as last from events group by user_id) select cast(user_id as varchar) as key, epoch_us(last) // 1000 as last from l where last + interval 6 hour <= (select max(last) from l) - interval 1 hour")
def stream_stall_timer(spark, d):
    """Users of whom nothing came for six hours of event time, by a timer each, the watermark an hour behind."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(kind).parquet(f"{d}/event*.parquet").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return runs.replay(runs.stalls(events, "6 hours", "1 hour"), "append", sinks.own_folder(spark, "stream"))
    finally:
        spark.conf.set(store, before)


@query("stream_new_files", ["log_v"], "select run, cast(sum(length(line) + 1) as bigint) as size from log_v where line is not null group by run")
def stream_new_files(spark, d):
    f = runs.replay(runs.new_files(spark, logs(spark, d), "*.txt"), "append", sinks.own_folder(spark, "stream"))
    return f.groupBy(F.regexp_extract("path", r"run=([^/]+)/", 1).alias("run")).agg(F.sum("size").alias("size"))


def _progress(spark, d):
    """Progress lines as JSON files that a stream reads."""
    path = sinks.own_folder(spark, "progress")
    c = view(spark, d, "clusters_v").select("l_orderkey", "line_no", "status")
    for part in ("line_no % 2 = 0", "line_no % 2 = 1"):
        sinks.append_progress(c.where(part), path)
    return spark.readStream.schema("l_orderkey long, line_no int, status string").option("maxFilesPerTrigger", 1000).json(path)


@query("stream_progress", ["clusters_v"], "select l_orderkey as unit, line_no as seq, status from (select *, row_number() over (partition by l_orderkey order by line_no desc, status desc) as rn from clusters_v) where rn = 1")
def stream_progress(spark, d):
    p = _progress(spark, d).select(F.col("l_orderkey").alias("unit"), F.col("line_no").alias("seq"), "status")
    return runs.replay(runs.latest_status(p), "complete", sinks.own_folder(spark, "stream"))


@query("stream_failure_budget", ["clusters_v"], "n as (select count(*) as n from (select distinct l_orderkey, line_no from clusters_v where status = 'failed')) select n from n where n > 100")
def stream_failure_budget(spark, d):
    """How many distinct members have failed, once that is beyond a hundred."""
    p = _progress(spark, d).where("status = 'failed'").select(F.col("l_orderkey").alias("family_id"), F.col("line_no").alias("member_id"))
    return runs.replay(runs.failing(p), "complete", sinks.own_folder(spark, "stream")).where("n > 100")
