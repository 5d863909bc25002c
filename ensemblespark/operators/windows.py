"""Windows and draws over trajectories: slots, pairs, windows, seeded walks, resumable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import unit_hash
from .selection import ranked

#: Lines of a run that one window orders at a time.
CHUNK = 10_000
#: Windows of all lengths of trajectories together, up to which they are made once a length and broadcast.
SHARED = 500_000


def spread(members: DataFrame) -> DataFrame:
    """Rows dealt out evenly before each becomes very many: a file's blocks hold few members' rows but are a task's whole work."""
    return members.repartition(8 * members.sparkSession.sparkContext.defaultParallelism)


def iid_slots(members: DataFrame, stride: int) -> DataFrame:
    """Every stride-th frame of a trajectory, and one slot (null frame) of a static member."""
    frames = F.when(F.col("is_trajectory"), F.expr(f"sequence(0, n_frames - 1, {max(1, stride)})")).otherwise(F.array(F.lit(None).cast("int")))
    return members.select("family_id", "member_id", F.explode(F.when(F.col("is_trajectory") & (F.col("n_frames") <= 0), F.array().cast("array<int>")).otherwise(frames)).alias("frame"))


def windows(members: DataFrame, ladder: list[int], stride: int, width: int) -> DataFrame:
    """(family_id, member_id, step, start, frames): every window of `width` frames at each ladder
    step of every trajectory; starts advance by stride and stop before the last frame would leave it."""
    span = F.col("step") * (width - 1)
    steps = spread(members.where("is_trajectory").select("family_id", "member_id", "n_frames")).select("family_id", "member_id", "n_frames", F.explode(F.array(*map(F.lit, ladder))).alias("step"))
    starts = steps.where(F.col("n_frames") > span).select("family_id", "member_id", "step", F.explode(F.sequence(F.lit(0), F.col("n_frames") - span - 1, F.lit(max(1, stride)))).alias("start"))
    return starts.withColumn("frames", F.array(*[F.col("start") + k * F.col("step") for k in range(width)]))


def static_pairs(members: DataFrame) -> DataFrame:
    """Ordered pairs of distinct structures of a family's static members."""
    own = members.where(~F.col("is_trajectory")).select("family_id", "member_id", "path")
    return own.select("family_id", F.col("member_id").alias("source"), F.col("path").alias("p")).join(own.select("family_id", F.col("member_id").alias("target"), F.col("path").alias("q")), "family_id").where("p <> q").select("family_id", "source", "target")


def oriented(rows: DataFrame, seed: int, prob: float, min_start: int, max_step: int) -> DataFrame:
    """Windows with their frames reversed where eligible and the window's own coin says so."""
    coin = unit_hash(F.lit(seed), F.col("family_id"), F.col("member_id"), F.col("start"), F.col("step"), sep="|")
    flip = (F.col("start") >= min_start) & (F.col("step") <= max_step) & (coin < prob)
    return rows.withColumn("reversed", flip).withColumn("frames", F.when(flip, F.reverse("frames")).otherwise(F.col("frames")))


def window_ends(members: DataFrame, ladder: list[int], stride: int, width: int) -> DataFrame:
    """(family_id, member_id, step, start, last): windows() by their first and last frame alone."""
    span = F.col("step") * (width - 1)
    steps = spread(members.where("is_trajectory").select("family_id", "member_id", "n_frames")).select("family_id", "member_id", "n_frames", F.explode(F.array(*map(F.lit, ladder))).alias("step"))
    starts = steps.where(F.col("n_frames") > span).select("family_id", "member_id", "step", F.explode(F.sequence(F.lit(0), F.col("n_frames") - span - 1, F.lit(max(1, stride)))).alias("start"))
    return starts.withColumn("last", F.col("start") + span)


def window_rows(members: DataFrame, ladder: list[int], stride: int, width: int, own: dict[str, Column] | None = None, **more: Column) -> DataFrame:
    """window_ends() with more columns: `own` of a trajectory, `more` of step, start and last alone. Trajectories of one length have
    the same windows: these are made once and joined by length, unless the lengths are so many that each trajectory makes its own."""
    own = own or {}
    moving = members.where("is_trajectory").select("family_id", "member_id", "n_frames")
    lengths = moving.select("n_frames").distinct()
    counts = [F.greatest(F.lit(0), F.ceil((F.col("n_frames") - step * (width - 1)) / max(1, stride))) for step in ladder]
    total = lengths.agg(F.sum(sum(counts[1:], counts[0]))).first()[0] or 0
    if total > SHARED:
        return window_ends(members, ladder, stride, width).withColumns({**own, **more})
    made = window_ends(lengths.select(F.col("n_frames").alias("family_id"), F.lit(0).alias("member_id"), "n_frames", F.lit(True).alias("is_trajectory")), ladder, stride, width)
    made = made.withColumns(more).drop("member_id").withColumnRenamed("family_id", "n_frames")
    return spread(moving.withColumns(own)).join(F.broadcast(made), "n_frames").drop("n_frames")  # SHARED rows at most, counted


def coin(digest: Column, prob: float) -> Column:
    """Whether a window's hash point is below prob: its hexadecimal digits against the first sixteen of prob's, compared as
    text, which for digits is the order of the numbers."""
    return F.lit(prob >= 1) | (digest < F.lit(f"{int(prob * 2**64):016x}" if prob < 1 else "g"))


def coin_text(seed: int) -> tuple[Column, Column]:
    """What a window's coin is the hash of, in two parts: of its trajectory, of its place."""
    text = lambda *names: [F.col(c).cast("string") for c in names]
    return F.concat_ws("|", F.lit(str(seed)), *text("family_id", "member_id"), F.lit("")), F.concat_ws("|", *text("start", "step"))


def oriented_ends(rows: DataFrame, seed: int, prob: float, min_start: int, max_step: int) -> DataFrame:
    """window_ends() with `reversed`, and source and target frame. The coin is only thrown within the gate; rows may
    have the parts of its text, as `trajectory` and `place`."""
    text = ("trajectory", "place") if "place" in rows.columns else coin_text(seed)
    flip = F.when((F.col("start") >= min_start) & (F.col("step") <= max_step), coin(F.sha2(F.concat(*text), 256), prob)).otherwise(False)
    out = rows.withColumn("reversed", flip)
    return out.select("family_id", "member_id", "step", "start", "reversed", F.when(F.col("reversed"), F.col("last")).otherwise(F.col("start")).alias("source_frame"), F.when(F.col("reversed"), F.col("start")).otherwise(F.col("last")).alias("target_frame"))


def chunks(rows: DataFrame, group: str, order: str, size: int, least: int = 1) -> DataFrame:
    """(group, chunk, n, first): consecutive chunks of a group's rows in order; a short tail is
    dropped unless it is all there is."""
    by = Window.partitionBy(group)
    own = rows.select(group, order, (F.row_number().over(by.orderBy(order)) - 1).alias("_i"), F.count("*").over(by).alias("_n"))
    keep_ = (F.col("_n") < size) | (F.floor(F.col("_i") / size) < F.floor(F.col("_n") / size))
    out = own.where(keep_).groupBy(group, F.floor(F.col("_i") / size).alias("chunk")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return out.where(F.col("n") >= least)


def walk(rows: DataFrame, group: str, item: str, k: int, epoch: int, seed: int, tag: str, one_pass: bool = False) -> DataFrame:
    """(group, place, item): the epoch's k items of a walk through seeded permutations of a
    group's items. Every item comes once before any comes twice; each cycle has a permutation
    of its own, by the hash of (seed, group, tag, cycle, item)."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    start = epoch * k
    places = sizes.select(group, "_n", F.explode(F.sequence(F.lit(start), F.lit(start + k - 1))).alias("_p"))
    places = places.where(F.col("_p") < F.col("_n")) if one_pass else places
    places = places.select(group, (F.col("_p") - start).alias("place"), F.floor(F.col("_p") / F.col("_n")).alias("_cycle"), (F.col("_p") % F.col("_n")).alias("_at"))
    cycles = places.select(group, "_cycle").distinct()
    mixed = rows.join(cycles, group).withColumn("_h", F.sha2(F.concat_ws("\x00", F.lit(seed).cast("string"), F.col(group).cast("string"), F.lit(tag), F.col("_cycle").cast("string"), F.col(item).cast("string")), 256))
    ranked = mixed.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_cycle").orderBy("_h", item)) - 1)
    return places.join(ranked.select(group, "_cycle", "_at", item), [group, "_cycle", "_at"]).select(group, "place", item)


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, skip: int) -> DataFrame:
    """(key, h): rows in the order of a hash of (seed, epoch, key), the first `skip` left out. The
    order is the hash itself; places are counted by ranges of it, whatever `skip` is."""
    own = rows.select(key, F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), F.lit(epoch).cast("string"), F.col(key).cast("string")), 256).alias("h"))
    return ranked(own, [], ["h", key], "_place").where(F.col("_place") > skip).select(key, "h")


def start_grid(members: DataFrame, n_starts: int, horizon: int) -> DataFrame:
    """(family_id, member_id, start): up to n_starts evenly spaced starts that leave the horizon, rounded half to even."""
    last = F.when(F.col("n_frames") - 1 - horizon < 0, F.col("n_frames") - 1).otherwise(F.col("n_frames") - 1 - horizon)
    grid = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n_starts - 1)), lambda i: F.bround(i * (F.col("_last") / (n_starts - 1))).cast("int")))
    return members.where("is_trajectory").withColumn("_last", last).select("family_id", "member_id", F.explode(F.when((F.col("_last") <= 0) | F.lit(n_starts <= 1), F.array(F.lit(0))).otherwise(grid)).alias("start"))


def lag_pairs(frames: DataFrame, lag: int) -> DataFrame:
    """(replica, frame_idx, value, later): values of a frame and of the one `lag` later, in one run of a segment: no frame
    of another segment lies between."""
    by = Window.partitionBy("replica").orderBy("frame_idx")
    run = frames.select("replica", "frame_idx", "value", (~F.col("segment").eqNullSafe(F.lag("segment").over(by))).cast("int").alias("_new"))
    run = run.select("replica", "frame_idx", "value", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    out = run.select("replica", "frame_idx", "value", "_run", F.lead("value", lag).over(by).alias("later"), F.lead("_run", lag).over(by).alias("_to"))
    return out.where("_to = _run").select("replica", "frame_idx", "value", "later")


def rolling_mean(rows: DataFrame, group: str, order: str, value: str, width: int) -> DataFrame:
    by = Window.partitionBy(group).orderBy(order).rowsBetween(1 - width, 0)
    return rows.select(group, order, F.avg(value).over(by).alias("mean"))


def adaptive_mean(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, order, window, mean): rolling mean over the last `window` rows of a group, holes (null values) stepped over; the
    window grows with the group, a fortieth of its rows but 10 at least and 200 at most. Running sums are
    taken once, and those of `window` rows before are joined."""
    by = Window.partitionBy(group).orderBy(order)
    n = rows.groupBy(group).agg(F.least(F.lit(200), F.greatest(F.lit(10), F.floor(F.count("*") / 40).cast("int"))).alias("window"))
    before = by.rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(group, order, F.row_number().over(by).alias("_i"), F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(before).alias("_s"), F.count(value).over(before).alias("_c")).join(n, group)
    old = run.select(group, (F.col("_i") + F.col("window")).alias("_i"), F.col("_s").alias("_os"), F.col("_c").alias("_oc"))
    both = run.join(old, [group, "_i"], "left")
    count = F.col("_c") - F.coalesce("_oc", F.lit(0))
    return both.select(group, order, "window", F.when(count > 0, (F.col("_s") - F.coalesce("_os", F.lit(0.0))) / count).alias("mean"))


def superseded(rows: DataFrame, run: str, order: str, step: str) -> DataFrame:
    """Rows not replaced by a later line: a step that is written again replaces every step at or after it.

    A run is cut into chunks of CHUNK lines. Each chunk's least step, a small table, gives the least
    of the chunks after it; within a chunk one running minimum from the last line up does the rest."""
    own = rows.withColumn("_chunk", F.floor(F.col(order) / CHUNK))
    least = own.groupBy(run, "_chunk").agg(F.min(step).alias("_least"))
    later = Window.partitionBy(run).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select(run, "_chunk", F.min("_least").over(later).alias("_later"))
    after = Window.partitionBy(run, "_chunk").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = own.join(least, [run, "_chunk"]).withColumn("_next", F.least(F.min(step).over(after), "_later"))
    return own.where(F.col("_next").isNull() | (F.col(step) < F.col("_next"))).select(*rows.columns)


def label_runs(rows: DataFrame, group: str, order: str, label: str) -> DataFrame:
    """(group, label, first, last, n): runs of equal labels in order."""
    by = Window.partitionBy(group).orderBy(order)
    island = rows.withColumn("_i", F.row_number().over(by) - F.row_number().over(Window.partitionBy(group, label).orderBy(order)))
    return island.groupBy(group, label, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_i")


def absorbed_runs(rows: DataFrame, group: str, order: str, label: str, least: int) -> DataFrame:
    """label_runs() without short ones: a run of fewer than `least` rows, but for a group's first, goes to the run on its
    left; then neighbours of one label are one run."""
    runs = label_runs(rows, group, order, label)
    by = Window.partitionBy(group).orderBy("first")  # a group's runs
    kept = runs.select("*", F.row_number().over(by).alias("_k"), F.max("last").over(Window.partitionBy(group)).alias("_end")).where((F.col("_k") == 1) | (F.col("n") >= least))
    own = kept.select("*", F.coalesce(F.lead("first").over(by) - 1, F.col("_end")).alias("_to"), F.lag(label).over(by).alias("_before"))
    island = own.withColumn("_i", F.sum((~F.col(label).eqNullSafe(F.col("_before"))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(group, label, "_i").agg(F.min("first").alias("first"), F.max("_to").alias("last")).drop("_i")


def zscore_tail(rows: DataFrame, group: str, order: str, value: str, tail: int) -> DataFrame:
    """Values less the mean of their group's tail (order >= tail), over its deviation (1 if that is 0)."""
    stats = rows.where(F.col(order) >= tail).groupBy(group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    sd = F.when(F.coalesce("_s", F.lit(0.0)) > 0, F.col("_s")).otherwise(1.0)
    return rows.join(stats, group, "left").select(group, order, ((F.col(value) - F.coalesce("_m", F.lit(0.0))) / sd).alias("z"))


def odd_features(values: Column, width: int) -> list[Column]:
    """Five features of a window of values that a reversal negates: projections on the first and
    third Legendre polynomials, differences between the halves in variance and in roughness,
    and the place of the maximum less that of the minimum (means over ties)."""
    t = [2.0 * i / (width - 1) - 1.0 for i in range(width)]
    p3 = [0.5 * (5 * x**3 - 3 * x) for x in t]

    def project(basis: list[float]) -> Column:
        dot = F.aggregate(F.zip_with(values, F.array(*map(F.lit, basis)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return dot / sum(b * b for b in basis)

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def variance(a: Column) -> Column:
        m = mean(a)
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)

    half = width // 2
    steps = F.zip_with(F.slice(values, 2, width - 1), F.slice(values, 1, width - 1), lambda a, b: (a - b) * (a - b))
    part = (width - 1) // 2
    place = lambda best: mean(F.transform(F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda s: s["v"] == best), lambda s: s["i"].cast("double")))
    return [
        project(t).alias("legendre1"), project(p3).alias("legendre3"),
        (variance(F.slice(values, width - half + 1, half)) - variance(F.slice(values, 1, half))).alias("var_drift"),
        (mean(F.slice(steps, width - part, part)) - mean(F.slice(steps, 1, part))).alias("rough_asym"),
        ((place(F.array_max(values)) - place(F.array_min(values))) / (width - 1)).alias("arg_asym"),
    ]


def window_values(frames: DataFrame, width: int) -> DataFrame:
    """(replica, start, values): every window of `width` consecutive values of a replica."""
    by = Window.partitionBy("replica").orderBy("frame_idx").rowsBetween(0, width - 1)
    return frames.select("replica", F.col("frame_idx").alias("start"), F.collect_list("value").over(by).alias("values")).where(F.size("values") == width)


def may_reverse(start: Column, step: Column, min_start: int = 1000, max_step: int = 64, prob: float = 0.5) -> Column:
    """Whether a window may be reversed at all."""
    return F.lit(prob > 0) & (start >= min_start) & (step <= max_step)


def _grid(first: Column, stop: Column, by: Column) -> Column:
    """Whole numbers from first up to, not including, stop; none if there are none."""
    return F.when(first < stop, F.sequence(first.cast("int"), (stop - 1).cast("int"), by.cast("int"))).otherwise(F.array().cast("array<int>"))


def _stop(n_frames: Column, step: Column, width: int, hi: Column) -> Column:
    """One more than the last start: a window's span must leave a frame after it, and a bin's end is not in the bin."""
    return F.least(n_frames - (width - 1) * step, F.coalesce(hi, n_frames))


def nonoverlap_starts(n_frames: Column, step: Column, width: int, lo: Column, hi: Column) -> Column:
    """Starts in [lo, hi) whose windows of `width` frames share at most an end; hi may be null."""
    return _grid(lo, _stop(n_frames, step, width, hi), F.greatest((width - 1) * step, F.lit(1)))


def emitted_starts(n_frames: Column, step: Column, width: int, lo: Column, hi: Column, stride: int) -> Column:
    """Starts in [lo, hi) that are multiples of `stride`; hi may be null."""
    return _grid(F.ceil(lo / float(stride)) * stride, _stop(n_frames, step, width, hi), F.lit(stride))


def window_violations(frames: Column, source: Column, target: Column) -> Column:
    """Faults of a window: a repeated frame, a last frame that isn't the target, a first one that isn't the source."""
    checks = [(F.size(F.array_distinct(frames)) < F.size(frames), "repeat"), (F.element_at(frames, -1) != target, "target"), (F.element_at(frames, 1) != source, "source")]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))


def window_faults(frames: list[Column], source: Column, target: Column) -> dict[str, Column]:
    """window_violations() as a condition by name, of a window given by a column per frame; arithmetic alone, no arrays."""
    repeat = F.lit(False)
    for i, a in enumerate(frames):
        for b in frames[i + 1 :]:
            repeat = repeat | (a == b)
    return {"repeat": repeat, "target": frames[-1] != target, "source": frames[0] != source}


def pooled(frames: DataFrame, family: str, replica: str, order: str, stride: int, least: int) -> DataFrame:
    """(family, replica, order, place): every stride-th frame of replicas of at least `least` frames, numbered through
    a family, replica after replica. Only the replicas' sizes are added up across a family."""
    by = Window.partitionBy(replica)
    own = frames.select(family, replica, order, (F.row_number().over(by.orderBy(order)) - 1).alias("_i"), F.count("*").over(by).alias("_n"))
    kept = own.where((F.col("_n") >= least) & (F.col("_i") % stride == 0))
    sizes = kept.groupBy(family, replica).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(family).orderBy(replica).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(family, replica, before.alias("_before"))
    return kept.join(offsets, [family, replica]).select(family, replica, order, (F.col("_before") + F.floor(F.col("_i") / stride) + 1).cast("long").alias("place"))
