"""Queries over run logs and their streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources import text as T
from .catalogs import rounded
from .views import oracle, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: list[str], sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(views, sql)
        return f

    return register


ROWS = "r as (select run, line_no, line_no % 5000 as step, case when event_type = 'view' then 'val' else 'train' end as kind, case when event_type <> 'view' then line_no * 8 end as samples, cast(cast(value as decimal(18,4)) as double) as loss from log_v)"


def _rows(spark, d):
    return T.run_log(view(spark, d, "log_v"), "run", "line_no", "line")


@query("scan_run_log", ["log_v"], ROWS + " select run, line_no, step, kind, samples, round(loss, 4) as loss from r")
def scan_run_log(spark, d):
    return _rows(spark, d).select("run", "line_no", "step", "kind", "samples", F.round("loss", 4).alias("loss"))


@query("resume_dedup", ["log_v"], ROWS + " select run, line_no, step, kind from (select *, min(step) over (partition by run order by line_no rows between 1 following and unbounded following) as n from r) where n is null or step < n")
def resume_dedup(spark, d):
    return W.superseded(_rows(spark, d), "run", "line_no", "step").select("run", "line_no", "step", "kind")


@query("best_point", ["log_v"], ROWS + " select run, round(loss, 4) as loss, step from (select *, row_number() over (partition by run order by loss, step) as rn from r where kind = 'val') where rn = 1")
def best_point(spark, d):
    g = _rows(spark, d).where("kind = 'val'").groupBy("run").agg(F.min(F.struct("loss", "step")).alias("b"))
    return g.select("run", F.round("b.loss", 4).alias("loss"), "b.step")


@query("accumulation_factor", ["log_v"], ROWS + """,
    p as (select run, samples - lag(samples) over w as df, step - lag(step) over w as ds from r where kind = 'train' window w as (partition by run order by line_no)),
    o as (select run, df / ds as f, row_number() over (partition by run order by df / ds) - 1 as i, count(*) over (partition by run) as n from p where ds > 0 and df > 0)
    select run, cast(greatest(1, round_even(f, 0)) as bigint) as factor from o where i = n // 2""")
def accumulation_factor(spark, d):
    """Samples per step: the upper median of the ratios of rises; a fall of either counter is left out."""
    by = Window.partitionBy("run").orderBy("line_no")
    r = _rows(spark, d).where("kind = 'train'").select("run", (F.col("samples") - F.lag("samples").over(by)).alias("a"), (F.col("step") - F.lag("step").over(by)).alias("b")).where("a > 0 and b > 0")
    # Equal ratios are one row; the middle one is the first whose count so far exceeds half of all.
    h = r.groupBy("run", (F.col("a") / F.col("b")).alias("f")).agg(F.count("*").alias("m"))
    upto, every = Window.partitionBy("run").orderBy("f"), Window.partitionBy("run")
    h = h.select("run", "f", F.sum("m").over(upto).alias("upto"), F.floor(F.sum("m").over(every) / 2).alias("middle"))
    return h.where("upto > middle").groupBy("run").agg(F.greatest(F.lit(1), F.bround(F.min("f"))).cast("long").alias("factor"))


@query("task_means", ["log_v"], ROWS + " select run, step // 100 as win, kind, round(avg(loss), 6) as mean, count(*) as n from r group by run, step // 100, kind")
def task_means(spark, d):
    return rounded(_rows(spark, d).groupBy("run", F.floor(F.col("step") / 100).alias("win"), "kind").agg(F.avg("loss").alias("mean"), F.count("*").alias("n")), "mean")


@query("write_metrics_long", ["log_v"], ROWS + " select run, kind, 'loss' as metric, step, round(loss, 4) as value from r union all select run, kind, 'samples', step, cast(samples as double) from r where samples is not null")
def write_metrics_long(spark, d):
    r = _rows(spark, d)
    return r.select("run", "kind", F.lit("loss").alias("metric"), "step", F.round("loss", 4).alias("value")).unionByName(r.where("samples is not null").select("run", "kind", F.lit("samples").alias("metric"), "step", F.col("samples").cast("double").alias("value")))


@query("parse_checkpoint_name", ["log_v"], """
    select line_no, run as prefix, case line_no % 5 when 0 then 'epoch_step' when 1 then 'epoch_end' when 2 then 'bestfwd' else 'stopped' end as kind, case when line_no % 5 < 2 then cast(line_no % 9 as int) end as epoch, case when line_no % 5 in (0, 2, 3) then line_no end as step from log_v where line_no % 5 <> 4""")
def parse_checkpoint_name(spark, d):
    """Checkpoints' file names of four kinds, among names that are none."""
    n, e = F.col("line_no").cast("string"), (F.col("line_no") % 9).cast("string")
    forms = [[F.lit("-epoch"), e, F.lit("-step"), n], [F.lit("-epoch"), e, F.lit("-end")], [F.lit("-bestfwd-step"), n], [F.lit("-stopped-step"), n], [F.lit("-last")]]
    name = F.element_at(F.array(*[F.concat("run", *f, F.lit(".ckpt")) for f in forms]), (F.col("line_no") % 5 + 1).cast("int"))
    own = view(spark, d, "log_v").select("line_no", name.alias("name"))
    return own.select("line_no", *T.checkpoint_name(F.col("name"))).where("kind is not null")


@query("thin_checkpoints", ["log_v"], """
    c as (select run, line_no % 5000 as step, line_no % 7 as epoch from log_v), t as (select run, max(step) as step, epoch from c where epoch % 2 = 0 group by run, epoch)
    select run, epoch, step from t""")
def thin_checkpoints(spark, d):
    c = view(spark, d, "log_v").select("run", (F.col("line_no") % 5000).alias("step"), (F.col("line_no") % 7).alias("epoch"))
    return c.where("epoch % 2 = 0").groupBy("run", "epoch").agg(F.max("step").alias("step"))


@query("prune_candidates", ["log_v"], "c as (select distinct run, line_no % 50 as step from log_v) select run, step from (select *, dense_rank() over (partition by run order by step desc) as r from c) where r > 5")
def prune_candidates(spark, d):
    c = view(spark, d, "log_v").select("run", (F.col("line_no") % 50).alias("step")).distinct()
    return c.select("run", "step", F.dense_rank().over(Window.partitionBy("run").orderBy(F.col("step").desc())).alias("r")).where("r > 5").drop("r")
