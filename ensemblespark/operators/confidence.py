"""Agreement of two ensembles' inner distances, point by point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import keep
from .suite import drawn, features

THRESHOLDS = (0.5, 1.0, 2.0, 4.0)


def frame_draws(cases: DataFrame, sizes: DataFrame, n_pairs: int, seed: int) -> DataFrame:
    """(case, k, a, b, fa, fb): n_pairs pairs of frames for each case (case, a, b), drawn by hash; a frame never meets
    itself. sizes is (ensemble_id, n); frames are numbered from 0. An ensemble of one frame can't meet itself."""
    size = lambda name: sizes.select(F.col("ensemble_id").alias(name), F.col("n").alias(f"n{name}"))
    k = cases.join(size("a"), "a").join(size("b"), "b").where((F.col("a") != F.col("b")) | (F.col("na") > 1)).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_pairs - 1))).alias("k"))
    draw = lambda side: drawn(F.lit(seed), F.col("case"), F.lit(side), F.col("k"))
    k = k.withColumn("fa", draw("a") % F.col("na"))
    other = F.when(F.col("a") == F.col("b"), (F.col("fa") + 1 + draw("b") % F.greatest(F.col("na") - 1, F.lit(1))) % F.col("na")).otherwise(draw("b") % F.col("nb"))
    return k.select("case", "k", "a", "b", "fa", other.alias("fb"))


def cross_lddt(rows: DataFrame, cases: DataFrame, n_pairs: int = 200, seed: int = 0, radius: float = 15.0, sep: int = 1) -> DataFrame:
    """(case, res_idx, lddt, sd, n): for each case (case, a, b) of ensembles of rows (ensemble_id, frame_idx, v), how well
    a point's distances to its neighbours are kept from a frame of one to a frame of the other, each being
    the reference once; mean and deviation over the drawn pairs of frames.

    A drawn pair is one row with both frames' distances, of which only those within the radius in either
    are opened: a neighbour list. The four thresholds and both directions are sums of one aggregate."""
    rows = keep(rows.select(F.col("ensemble_id").cast("string").alias("ensemble_id"), F.col("frame_idx").cast("long").alias("frame_idx"), "v"))
    sizes = rows.groupBy("ensemble_id").agg(F.count("*").alias("n"))
    draws = keep(frame_draws(cases.select(*[F.col(c).cast("string").alias(c) for c in ("case", "a", "b")]), sizes, n_pairs, seed))
    used = draws.select(F.explode(F.array(F.struct(F.col("a").alias("ensemble_id"), F.col("fa").alias("frame_idx")), F.struct(F.col("b").alias("ensemble_id"), F.col("fb").alias("frame_idx")))).alias("u")).select("u.*").distinct()
    own = keep(features(rows.join(used, ["ensemble_id", "frame_idx"]), sep).select("ensemble_id", "frame_idx", (F.size("v") / 3).cast("int").alias("l"), "f"))
    side = lambda e, f, d: own.select(F.col("ensemble_id").alias(e), F.col("frame_idx").alias(f), F.col("f").alias(d), F.col("l").alias(f"l{e}"))
    both = draws.join(side("a", "fa", "da"), ["a", "fa"]).join(side("b", "fb", "db"), ["b", "fb"])
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("la") - 1 - sep), lambda i: F.transform(F.sequence(i + sep, F.col("la") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    near = F.filter(F.arrays_zip(F.col("da"), F.col("db"), F.when(F.col("la") > sep, pairs).alias("p")), lambda x: (x["da"] < radius) | (x["db"] < radius))
    out = both.select("case", "k", "la", near.alias("near"))
    off = F.abs(F.col("x.da") - F.col("x.db"))
    kept = sum(((off < t).cast("double") for t in THRESHOLDS[1:]), (off < THRESHOLDS[0]).cast("double")) / len(THRESHOLDS)
    opened = out.select("case", "k", F.explode("near").alias("x")).select("case", "k", F.explode(F.array("x.p.i", "x.p.j")).alias("res_idx"), kept.alias("kept"), (F.col("x.da") < radius).cast("double").alias("in_a"), (F.col("x.db") < radius).cast("double").alias("in_b"))
    share = lambda c: F.coalesce(F.sum(F.col("kept") * F.col(c)) / F.nullif(F.sum(c), F.lit(0.0)), F.lit(0.0))
    scores = opened.groupBy("case", "k", "res_idx").agg(((share("in_a") + share("in_b")) / 2).alias("s"))
    every = out.select("case", "k", F.explode(F.sequence(F.lit(0), F.col("la") - 1)).alias("res_idx"))  # a point without neighbours scores 0
    return every.join(scores, ["case", "k", "res_idx"], "left").groupBy("case", "res_idx").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("lddt"), F.stddev_pop(F.coalesce("s", F.lit(0.0))).alias("sd"), F.count("*").alias("n"))
