"""Queries of the whole evaluation: suite, floor, time-lagged components, exact assignments.

The reference is ensemble 0. Each ensemble counts as three segments in time, of a third of its frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles as E
from ..operators import suite as S
from .catalogs import rounded
from .views import oracle, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Frames between the two of a lagged pair, where an ensemble has some fifty; frames of a floor's sample.
LAG, FLOOR_FRAMES, FLOOR_DRAWS = 5, 20, 3


def query(name: str, views: list[str], sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(views, sql)
        return f

    return register


def _rows(spark, d):
    return E.flat(view(spark, d, "frames_v"))


def _segments(rows):
    n = rows.groupBy("ensemble_id").agg(F.count("*").alias("n"))
    return rows.select("ensemble_id", "frame_idx").join(n, "ensemble_id").select("ensemble_id", "frame_idx", F.floor(F.col("frame_idx") * 3 / F.col("n")).alias("segment"))


def _exposure(spark, d):
    return view(spark, d, "frames_v").select("ensemble_id", "frame_idx", "res_idx", (F.abs("x") > 2.5).alias("on"))


def _arms(rows):
    return rows.select("ensemble_id").distinct().where("ensemble_id <> 0").select(F.col("ensemble_id").cast("string").alias("case"), F.col("ensemble_id").alias("gen"), F.lit(0).alias("ref"))


@query("ensemble_suite", [])
def ensemble_suite(spark, d):
    """Every tier of every ensemble against the reference, a row per metric."""
    rows = _rows(spark, d)
    return rounded(S.ensemble_suite(rows, _arms(rows), _segments(rows), LAG, exposure=_exposure(spark, d)).select(F.col("case").alias("ensemble_id"), "metric", "value"), "value", digits=4)


@query("reference_floor", [])
def reference_floor(spark, d):
    """Every ensemble's halves against each other, in draws: mean, deviation and number of each metric's values."""
    rows = _rows(spark, d)
    return rounded(S.reference_floor(rows, _segments(rows), FLOOR_FRAMES, FLOOR_DRAWS, LAG), "mean", "sd", digits=4)


def _features(rows, sep: int):
    """Distances of every third point, three and more apart: fewer than an ensemble has frames."""
    third = F.filter("v", lambda _, k: F.floor(k / 3) % 3 == 0)
    return S.features(rows.withColumn("v", third), sep)


@query("tica", [])
def tica(spark, d):
    """The slowest components of each ensemble's inner distances, a lag apart within a segment."""
    rows = _rows(spark, d)
    placed = _features(rows.join(_segments(rows), ["ensemble_id", "frame_idx"]), 1)
    return rounded(S.tica(placed.select(F.col("ensemble_id").cast("string").alias("sample"), "segment", F.col("frame_idx").cast("long").alias("place"), "f"), LAG, 3).select(F.col("sample").alias("ensemble_id"), "axis", "eigenvalue"), "eigenvalue", digits=5)


@query("optimal_w2", [])
def optimal_w2(spark, d):
    """Exact distance of each ensemble's cloud from the reference's, over as many frames of both as the smaller has."""
    rows = _rows(spark, d)
    n = rows.groupBy("ensemble_id").agg(F.count("*").alias("n"))
    base = n.where("ensemble_id = 0").select(F.col("n").alias("n0"))
    sizes = n.where("ensemble_id <> 0").crossJoin(F.broadcast(base)).select("ensemble_id", F.least("n", "n0").alias("k"))  # one row
    own = rows.join(sizes, "ensemble_id").where(F.col("frame_idx") < F.col("k")).select(F.col("ensemble_id").cast("string").alias("case"), F.lit(1).alias("side"), F.col("v").alias("x"))
    k = sizes.groupBy("k").agg(F.collect_list("ensemble_id").alias("arms"))  # a row per size, names of arms
    ref = rows.where("ensemble_id = 0").join(k, F.col("frame_idx") < F.col("k")).select(F.explode("arms").alias("arm"), "v").select(F.col("arm").cast("string").alias("case"), F.lit(0).alias("side"), F.col("v").alias("x"))
    out = S.optimal_w2(own.union(ref).withColumn("scale", F.size("x") / 3))
    return rounded(out.select(F.col("case").alias("ensemble_id"), "w2", "violation"), "w2")


@query("optimal_w2_ranks", ["trajectory_v"], """
    s as (select family_id, replica // 20 % 2 as side, value, row_number() over (partition by family_id, segment, replica // 20 % 2 order by value) as r, count(*) over (partition by family_id, segment, replica // 20 % 2) as n, segment from trajectory_v),
    k as (select family_id, segment, min(n) as k from s group by family_id, segment having count(distinct side) = 2),
    p as (select family_id, segment, r, max(case when side = 0 then value end) as a, max(case when side = 1 then value end) as b from s join k using (family_id, segment) where r <= k group by family_id, segment, r)
    select family_id, segment, round(sqrt(avg((a - b) * (a - b))), 6) as w2, count(*) as n from p group by family_id, segment""")
def optimal_w2_ranks(spark, d):
    """In one dimension: the observable in every other replica of a family and segment, over as many of the least values as the smaller side has."""
    from ..operators.selection import ranked

    rows = view(spark, d, "trajectory_v").select("family_id", "segment", (F.floor(F.col("replica") / 20) % 2).alias("side"), "value")
    by = ["family_id", "segment"]
    sizes = rows.groupBy(*by).agg(F.sum((F.col("side") == 0).cast("long")).alias("n0"), F.sum((F.col("side") == 1).cast("long")).alias("n1")).select(*by, F.least("n0", "n1").alias("k")).where("k > 0")
    least = ranked(rows, [*by, "side"], ["value"], "r").join(sizes, by).where(F.col("r") <= F.col("k"))
    return rounded(S.rank_w2(least, by, "side", "value").join(sizes.withColumnRenamed("k", "n"), by).select(*by, "w2", "n"), "w2")


def _onto_reference(spark, d):
    """All ensembles' frames superposed onto the reference structure."""
    rows = _rows(spark, d)
    first = rows.where("ensemble_id = 0 and frame_idx = 0").select("v").first()  # one frame
    return E.superposed(rows, list(first.v) if first else []).select("ensemble_id", "frame_idx", "v", F.lit("all").alias("label"))


@query("frame_pair_rmsd_superposed", [])
def frame_pair_rmsd(spark, d):
    """Each frame's distances, once superposed onto the reference structure, to all frames of its ensemble and to all of the reference's."""
    from ..sinks import keep

    rows = keep(_onto_reference(spark, d))
    own = E.frame_distances(rows).select("ensemble_id", "frame_idx", F.lit("own").alias("other"), "total", "n")
    return rounded(own.union(_across(rows).select("ensemble_id", "frame_idx", F.lit("reference"), "total", "n")), "total", digits=5)


def _across(rows):
    """Distances of every ensemble's frames to the reference's: the frames of all arms are one ensemble that
    meets the reference in blocks; nothing is copied per arm."""
    arms = rows.where("ensemble_id <> 0").select(F.lit(0).alias("ensemble_id"), F.concat_ws("|", F.col("ensemble_id").cast("string"), F.col("frame_idx").cast("string")).alias("frame_idx"), "v", "label")
    ref = rows.where("ensemble_id = 0").select(F.lit(0).alias("ensemble_id"), F.col("frame_idx").cast("string").alias("frame_idx"), "v", "label")
    part = lambda i: F.split_part("frame_idx", F.lit("|"), F.lit(i)).cast("int")
    return E.frame_distances(arms, ref).select(part(1).alias("ensemble_id"), part(2).alias("frame_idx"), "total", "n")


@query("pairwise_rmsd_superposed", [])
def pairwise_rmsd(spark, d):
    """Mean distance of superposed frames within an ensemble, without its bias, to the reference's frames, and the first's error."""
    from ..sinks import keep

    rows = keep(_onto_reference(spark, d))
    own = E.frame_distances(rows).groupBy("ensemble_id").agg((F.sum("total") / F.sum("n")).alias("own"), F.count("*").alias("n"))
    across = _across(rows).groupBy("ensemble_id").agg((F.sum("total") / F.sum("n")).alias("across"))
    base = own.where("ensemble_id = 0").select(F.col("own").alias("ref"))
    out = own.join(across, "ensemble_id", "left").crossJoin(F.broadcast(base))  # one row
    debiased = F.when(F.col("n") > 1, F.col("own") * F.col("n") / (F.col("n") - 1))
    return rounded(out.select("ensemble_id", "own", debiased.alias("debiased"), "across", F.abs(F.col("own") - F.col("ref")).alias("error")), "own", "debiased", "across", "error", digits=5)


@query("collapse_guard_suite", [])
def collapse_guard(spark, d):
    """The guard as the suite has it, a row per ensemble: superposed frames, a reference sample of equal size, effective dimensions, bonds, clashes and the verdict."""
    rows = _rows(spark, d)
    scored = S.ensemble_suite(rows, _arms(rows), _segments(rows), LAG)
    names = ["diversity_ratio", "rmsf_mean_ratio", "n_eff_gen", "n_eff_ref", "ca_bond_violation_fraction_gen", "ca_bond_violation_fraction_ref", "clash_fraction_gen", "clash_fraction_ref"]
    wide = scored.where(F.col("metric").isin(names)).groupBy(F.col("case").alias("ensemble_id")).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    return rounded(wide.withColumn("verdict", E.diversity(F.col("diversity_ratio"))), *names, digits=5)
