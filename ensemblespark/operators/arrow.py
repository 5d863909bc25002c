"""The time arrow of windows: design rows, a discriminant per cell with its null, and the gate that keeps reversal harmless."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import keep, small

#: Random labellings of a null; shares of contamination and of asymmetry that a gate may let through; probability of a reversal.
NULL_DRAWS, BUDGET, STRENGTH, PROB = 1000, 0.01, 0.25, 0.5


def window_matrix(series: DataFrame, steps: list[int], width: int) -> DataFrame:
    """(unit, step, start, x): for every window of `width` frames, `step` apart, of a unit's series (unit, obs,
    frame_idx, z), the five odd features of each observable, in order of obs. A window has all its
    frames or is none; all frames of all steps come from one ordering of a series."""
    kinds = dict(series.dtypes)
    own = series.where("frame_idx is not null").select("unit", "obs", "frame_idx", F.col("z").cast("double").alias("z"), F.size(F.collect_set("obs").over(Window.partitionBy("unit"))).alias("n"))
    return own.sortWithinPartitions("unit", "frame_idx", "obs").mapInArrow(_windows(steps, width), f"unit {kinds['unit']}, step int, start {kinds['frame_idx']}, x array<double>")


def _features(v: np.ndarray) -> list[np.ndarray]:
    """odd_features() of the rows of v, summed in the same order."""
    width = v.shape[1]
    t = [2.0 * i / (width - 1) - 1.0 for i in range(width)]
    total = lambda a: sum((a[:, k] for k in range(a.shape[1])), np.zeros(len(a)))
    mean = lambda a: total(a) / a.shape[1]
    project = lambda basis: total(v * np.array(basis)) / sum(b * b for b in basis)
    variance = lambda a: mean((a - mean(a)[:, None]) ** 2)
    half, part, d = width // 2, (width - 1) // 2, (v[:, 1:] - v[:, :-1]) ** 2

    def place(best: np.ndarray) -> np.ndarray:
        hit = (v == best[:, None]) | (np.isnan(v) & np.isnan(best)[:, None])
        return (hit * np.arange(width)).sum(1) / hit.sum(1)

    return [project(t), project([0.5 * (5 * x**3 - 3 * x) for x in t]), variance(v[:, width - half :]) - variance(v[:, :half]), mean(d[:, width - 1 - part :]) - mean(d[:, :part]), (place(v.max(1)) - place(np.fmin.reduce(v, axis=1))) / (width - 1)]


def _windows(steps: list[int], width: int):
    """Rows (unit, obs, frame_idx, z, n), sorted by unit, frame and observable, as design rows. Of one batch only the
    frames that a window may still need are held for the next."""
    reach = max(steps) * (width - 1) + 2

    def made(batches):
        held = None
        for batch in batches:
            old = held.num_rows if held else 0
            rows = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks()
            unit, frame = rows.column("unit").combine_chunks(), rows.column("frame_idx").to_numpy()
            code = unit.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            n, null, z = rows.column("n").to_numpy(), rows.column("z").is_null().to_numpy(), rows.column("z").to_numpy()
            for k in np.unique(n):
                at = np.flatnonzero(n == k)
                first = np.flatnonzero(np.r_[True, (np.diff(code[at]) != 0) | (np.diff(frame[at]) != 0)])
                first = first[np.diff(np.r_[first, len(at)]) == k]
                if not len(first):
                    continue
                own = at[first[:, None] + np.arange(k)]
                u, f, fresh, bad, values = code[own[:, 0]], frame[own[:, 0]], own[:, -1] >= old, null[own].any(1), z[own]
                for step in steps:
                    span = step * (width - 1)
                    if len(f) <= span:
                        continue
                    i = np.flatnonzero((u[span:] == u[:-span]) & (f[span:] == f[:-span] + span) & fresh[span:])
                    i = i[~bad[i[:, None] + step * np.arange(width)].any(1)]
                    if len(i):
                        x = np.stack([c for o in range(k) for c in _features(values[i[:, None] + step * np.arange(width), o])], 1)
                        yield pa.RecordBatch.from_arrays([unit.take(pa.array(own[i, 0])), pa.array(np.full(len(i), step, np.int32)), pa.array(f[i]), pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["unit", "step", "start", "x"])
            if len(code):
                tail = max(len(code) - int(reach * n[-1]), int(np.flatnonzero(code != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0)
                held = rows.slice(tail).combine_chunks().to_batches()[0]

    return made


def directions(train: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """(cell, n_train, w): cov^-1 m of a cell's rows (cell, x), of unit length, with a ridge of that share of the
    mean variance. Rows leave only their sums of x and of products; a cell's matrix of features is solved."""

    def summed(batches):
        held: dict = {}
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False).astype(str)
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            for name in np.unique(cell):
                v = x[cell == name]
                n, s, g = held.get(name, (0, 0.0, 0.0))
                held[name] = (n + len(v), s + v.sum(0), g + v.T @ v)
        for name, (n, s, g) in held.items():
            p, q = (k.ravel().astype(np.int32) for k in np.indices(g.shape))
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(p)), pa.array(p), pa.array(q), pa.array(np.full(len(p), n)), pa.array(s[p]), pa.array(g.ravel())], names=["cell", "p", "q", "n", "s", "g"])

    sums = train.mapInArrow(summed, "cell string, p int, q int, n long, s double, g double").groupBy("cell", "p", "q").agg(*[F.sum(c).alias(c) for c in ("n", "s", "g")])

    def solved(rows: pa.Table) -> pa.Table:
        p, q, n = (rows.column(c).to_numpy() for c in ("p", "q", "n"))
        size = p.max() + 1
        g, m = np.zeros((size, size)), np.zeros(size)
        g[p, q], m[p] = rows.column("g").to_numpy(), rows.column("s").to_numpy() / n
        cov = (g - n[0] * np.outer(m, m)) / max(n[0] - 1, 1)
        w = np.linalg.solve(cov + ridge * (np.trace(cov) / size + 1e-12) * np.eye(size), m)
        length = np.linalg.norm(w)
        return pa.table({"cell": pa.array([rows.column("cell")[0].as_py()]), "n_train": pa.array([int(n[0])]), "w": pa.array([(w / length if length > 0 else w).tolist()], pa.list_(pa.float64()))})

    return sums.groupBy("cell").applyInArrow(solved, "cell string, n_train long, w array<double>")


def sign(key: Column, draw: Column) -> Column:
    """1 or -1 by hash."""
    return F.when(F.xxhash64(key, draw) % 2 == 0, 1.0).otherwise(-1.0)


def discriminant(rows: DataFrame, draws: int = NULL_DRAWS) -> DataFrame:
    """(cell, n_train, n_test, accuracy, separation, null_q99, status, strength) of rows (cell, key, x, train): how
    well a direction fitted on a cell's training rows tells the two orders apart on its others.

    An exact zero counts half. separation is the accuracy or its complement, whichever is larger. The null
    gives every test row, known by its key, a sign by hash, `draws` times; what is summed are the hits
    of each draw. A cell with fewer training rows than features and two, or fewer than three test rows
    a feature, is unestimable; one whose separation exceeds the null's 99th percentile is arrowed."""
    rows = rows.select(F.col("cell").cast("string").alias("cell"), F.col("key").cast("string").alias("key"), "x", F.col("train").cast("boolean").alias("train"))
    fitted = keep(directions(rows.where("train").select("cell", "x")))
    margin = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    test = keep(rows.where("not train").join(small(fitted.select("cell", "w"), fitted.count()), "cell").select("cell", "key", margin.alias("m")))
    credit = lambda m: F.avg(F.when(m > 0, 1.0).when(m == 0, 0.5).otherwise(0.0))
    seen = test.groupBy("cell").agg(F.count("*").alias("n_test"), credit(F.col("m")).alias("accuracy"))
    flipped = test.select("cell", "key", "m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k")).withColumn("m", F.col("m") * sign(F.col("key"), F.col("k")))
    null = flipped.groupBy("cell", "k").agg(credit(F.col("m")).alias("a")).groupBy("cell").agg(F.percentile(F.greatest("a", 1 - F.col("a")), F.lit(0.99)).alias("null_q99"))
    features = rows.groupBy("cell").agg(F.max(F.size("x")).alias("p"))
    out = features.join(fitted.select("cell", "n_train"), "cell", "left").join(seen, "cell", "left").join(null, "cell", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    known = (count("n_train") >= F.col("p") + 2) & (count("n_test") >= 3 * F.col("p"))
    only = lambda c: F.when(known, c)
    separation = F.greatest("accuracy", 1 - F.col("accuracy"))
    arrowed = separation > F.col("null_q99")
    return out.select(
        "cell", count("n_train").alias("n_train"), count("n_test").alias("n_test"), only(F.col("accuracy")).alias("accuracy"), only(separation).alias("separation"), only(F.col("null_q99")).alias("null_q99"),
        F.when(~known, "unestimable").when(arrowed, "arrowed").otherwise("clean").alias("status"), F.when(known & arrowed, F.greatest(F.lit(0.0), 2 * separation - 1)).otherwise(0.0).alias("strength"),
    )


def gate_grid(cells: DataFrame, prob: float = PROB) -> DataFrame:
    """(audit, min_start, max_step, contamination, n_eligible, n_arrowed, n_unestimable, max_strength, emit_share,
    feasible, certified) for every gate of an audit: its cells' starts and steps, (audit, start, step,
    emit, status, strength), one row a cell.

    A gate lets through the cells that start at or after it and step no farther. Each gate's sums are running
    sums over starts, downwards, of running sums over steps, upwards: every cell is added twice, and cells
    and gates are never crossed."""
    arrowed = F.col("status") == "arrowed"
    own = cells.groupBy("audit", "start", "step").agg(
        F.sum("emit").alias("emit"), F.sum(F.when(arrowed, F.col("emit") * F.col("strength")).otherwise(0.0)).alias("bad"), F.count("*").alias("n"), F.sum(arrowed.cast("long")).alias("a"),
        F.sum(((F.col("status") == "unestimable") & (F.col("emit") > 0)).cast("long")).alias("u"), F.max(F.when(arrowed, F.col("strength"))).alias("worst"),
    )
    ladder = lambda c: cells.select("audit", c).distinct()
    grid = ladder("start").join(ladder("step"), "audit").join(own, ["audit", "start", "step"], "left")  # an audit's starts by its steps
    up, down = (Window.partitionBy("audit", a).orderBy(b).rowsBetween(Window.unboundedPreceding, 0) for a, b in (("start", F.col("step")), ("step", F.col("start").desc())))
    sums = ("emit", "bad", "n", "a", "u")
    within = lambda by: [*[F.coalesce(F.sum(c).over(by), F.lit(0)).alias(c) for c in sums], F.max("worst").over(by).alias("worst")]
    both = grid.select("audit", "start", "step", *within(up)).select("audit", "start", "step", *within(down))
    total = cells.groupBy("audit").agg(F.sum("emit").alias("total"))
    share = lambda x: x / F.nullif(F.col("total"), F.lit(0))
    out = both.join(total, "audit").select(
        "audit", F.col("start").alias("min_start"), F.col("step").alias("max_step"), (prob * share(F.col("bad"))).alias("contamination"), F.col("n").alias("n_eligible"), F.col("a").alias("n_arrowed"), F.col("u").alias("n_unestimable"),
        F.coalesce("worst", F.lit(0.0)).alias("max_strength"), F.coalesce(share(F.col("emit")), F.lit(0.0)).alias("emit_share"),
    )
    feasible = F.coalesce((F.col("contamination") <= BUDGET) & (F.col("max_strength") <= STRENGTH), F.lit(False))
    return out.withColumn("feasible", feasible).withColumn("certified", feasible & (F.col("n_unestimable") == 0))


def gate_search(grid: DataFrame) -> DataFrame:
    """(audit, min_start, max_step, certified, reason): of an audit's certified gates the least restrictive, which lets
    most windows through; of several that with the smaller start, then the wider step. None: nulls and why."""
    best = F.max(F.when(F.col("certified"), F.struct("emit_share", (-F.col("min_start")).alias("s"), "max_step", "contamination", "max_strength"))).alias("b")
    out = grid.groupBy("audit").agg(best, F.sum(F.col("feasible").cast("long")).alias("f"))
    reason = F.when(F.col("b").isNotNull(), "certified").when(F.col("f") > 0, F.concat("f", F.lit(" feasible, none without unestimable cells"))).otherwise("none feasible")
    return out.select("audit", (-F.col("b.s")).alias("min_start"), F.col("b.max_step").alias("max_step"), F.col("b").isNotNull().alias("certified"), F.col("b.emit_share").alias("emit_share"), F.col("b.contamination").alias("contamination"), reason.alias("reason"))
