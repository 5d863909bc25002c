"""Queries over trajectories: windows, draws, orientation, series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import windows as W
from .catalogs import rounded
from .views import oracle, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The stride of starts, and the ladder of steps.
STRIDE, LADDER = 50, X.stride_ladder(1, 512)


def query(name: str, views: list[str], sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(views, sql)
        return f

    return register


@query("iid_slots", ["members_v"], """
    t as (select family_id, member_id, unnest(range(0, n_frames, 50)) as frame from members_v where is_trajectory)
    select family_id, member_id, cast(frame as int) as frame from t union all select family_id, member_id, null from members_v where not is_trajectory""")
def iid_slots(spark, d):
    return W.iid_slots(view(spark, d, "members_v"), STRIDE)


@query("stride_ladder", ["members_v"], "s as (select family_id, member_id, unnest([1, 2, 4, 8, 16, 20]) as step from members_v where is_trajectory) select step, count(*) as n from s group by step")
def stride_ladder(spark, d):
    m = view(spark, d, "members_v").where("is_trajectory").select(F.explode(F.array(*map(F.lit, X.stride_ladder(20, 1)))).alias("step"))
    return m.groupBy("step").agg(F.count("*").alias("n"))


@query("default_stride", ["members_v"], "select family_id, member_id, case when least(member_id * 100, n_frames) <= 256 and greatest(member_id * 100, n_frames) >= 256 then 256 else greatest(member_id * 100, n_frames) end as stride from members_v")
def default_stride(spark, d):
    return view(spark, d, "members_v").select("family_id", "member_id", X.default_stride(F.col("member_id") * 100, F.col("n_frames")).alias("stride"))


WINDOWS = """
    l as (select family_id, member_id, n_frames, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) as step from members_v where is_trajectory),
    w as (select family_id, member_id, step, cast(unnest(range(0, n_frames - 8 * step, 50)) as int) as start from l where n_frames > 8 * step)"""


@query("forward_pairs", ["members_v"], """
    s as (select family_id, member_id, n_frames, unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) as step from members_v where is_trajectory)
    select family_id, member_id, step, cast(count(*) as bigint) as n, cast(sum(start) as bigint) as starts from (select family_id, member_id, step, unnest(range(0, n_frames - step, 50)) as start from s where n_frames > step) group by family_id, member_id, step""")
def forward_pairs(spark, d):
    w = W.windows(view(spark, d, "members_v"), LADDER, STRIDE, 2)
    return w.groupBy("family_id", "member_id", "step").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query("trajectory_windows", ["members_v"], WINDOWS + " select family_id, member_id, step, count(*) as n, min(start) as first, max(start) as last, cast(sum(9 * start + 36 * step) as bigint) as frames from w group by family_id, member_id, step")
def trajectory_windows(spark, d):
    """Windows of nine frames by member and step: how many, the first and last start, the sum of all their frames."""
    w = W.window_ends(view(spark, d, "members_v"), LADDER, STRIDE, 9)
    own = (9 * F.col("start") + 36 * F.col("step")).cast("bigint")
    return w.groupBy("family_id", "member_id", "step").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"), F.sum(own).alias("frames"))


@query("static_pairs", ["members_v"], """
    s as (select * from members_v where not is_trajectory) select a.family_id, a.member_id as source, b.member_id as target from s a join s b on a.family_id = b.family_id and a.path <> b.path""")
def static_pairs(spark, d):
    return W.static_pairs(view(spark, d, "members_v"))


@query("chunk_windows", ["members_v"], """
    r as (select family_id, member_id, row_number() over (partition by family_id order by member_id) - 1 as i, count(*) over (partition by family_id) as n from members_v)
    select family_id, i // 2 as chunk, count(*) as n, min(member_id) as first from r where n < 2 or i // 2 < n // 2 group by family_id, i // 2""")
def chunk_windows(spark, d):
    return W.chunks(view(spark, d, "members_v"), "family_id", "member_id", 2)


@query("orient_window", ["members_v"], WINDOWS + """,
    f as (select *, start >= 1000 and step <= 64 and ('0x' || substr(sha256('3|' || family_id || '|' || member_id || '|' || start || '|' || step), 1, 12))::bigint / 281474976710656.0 < 0.5 as reversed from w)
    select family_id, member_id, step, count(*) as n, cast(sum(case when reversed then 1 else 0 end) as bigint) as reversed, cast(sum(case when reversed then start + 8 * step else start end) as bigint) as source_frames, cast(sum(case when reversed then start else start + 8 * step end) as bigint) as target_frames from f group by family_id, member_id, step""")
def orient_window(spark, d):
    """Windows after the reversal coin, by member and step: how many are reversed, sums of their first and last frames."""
    w = W.oriented_ends(W.window_ends(view(spark, d, "members_v"), LADDER, STRIDE, 9), 3, 0.5, 1000, 64)
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c.replace("frame", "frames"))
    return w.groupBy("family_id", "member_id", "step").agg(F.count("*").alias("n"), total("reversed"), total("source_frame"), total("target_frame"))


@query("reversal_gate", ["members_v"], WINDOWS + " select family_id, count(*) as n from w where start >= 1000 and step <= 64 and 0.5 > 0 group by family_id")
def reversal_gate(spark, d):
    """A family's windows that may be reversed: start and step within the gate, and a coin that can fall."""
    w = W.window_ends(view(spark, d, "members_v"), LADDER, STRIDE, 9)
    return w.where(W.may_reverse(F.col("start"), F.col("step"))).groupBy("family_id").agg(F.count("*").alias("n"))


# The windows themselves, a row each; the queries above sum them up for their SQL.


@query("trajectory_windows_whole", [])
def trajectory_windows_whole(spark, d):
    frames = F.concat_ws(" ", *[(F.col("start") + k * F.col("step")).cast("string") for k in range(9)])
    w = W.window_rows(view(spark, d, "members_v"), LADDER, STRIDE, 9, frames=frames)
    return w.select("family_id", "member_id", "step", "start", "frames")


@query("orient_window_whole", [])
def orient_window_whole(spark, d):
    trajectory, place = W.coin_text(3)
    return W.oriented_ends(W.window_rows(view(spark, d, "members_v"), LADDER, STRIDE, 9, {"trajectory": trajectory}, place=place), 3, 0.5, 1000, 64)


WALK = """
    n as (select family_id, count(*) as n from members_v group by family_id), p as (select family_id, n, unnest(range(6, 9)) as p from n),
    q as (select family_id, p - 6 as place, p // n as cycle, p % n as at from p), c as (select distinct family_id, cycle from q),
    r as (select m.family_id, c.cycle, m.member_id, row_number() over (partition by m.family_id, c.cycle order by sha256('1' || chr(0) || m.family_id || chr(0) || 'iid' || chr(0) || c.cycle || chr(0) || m.member_id), m.member_id) - 1 as at from members_v m join c using (family_id))
    select q.family_id, q.place, r.member_id from q join r on q.family_id = r.family_id and q.cycle = r.cycle and q.at = r.at"""


@query("permutation_walk", ["members_v"], WALK)
def permutation_walk(spark, d):
    return W.walk(view(spark, d, "members_v"), "family_id", "member_id", 3, 2, 1, "iid")


@query("draw_examples", ["members_v"], """
    r as (select family_id, member_id, row_number() over (partition by family_id order by sha256('1' || chr(0) || family_id || chr(0) || 'fwd' || chr(0) || '0' || chr(0) || member_id), member_id) as pos from members_v)
    select family_id, cast(pos - 1 as bigint) as place, member_id from r where pos <= 2""")
def draw_examples(spark, d):
    return W.walk(view(spark, d, "members_v"), "family_id", "member_id", 2, 0, 1, "fwd", one_pass=True)


@query("epoch_order", ["members_v"], """
    f as (select distinct family_id from members_v), h as (select family_id, sha256('7|2|' || family_id) as h from f)
    select family_id, h from (select *, row_number() over (order by h, family_id) as rn from h) where rn > 1000""")
def epoch_order(spark, d):
    return W.epoch_order(view(spark, d, "members_v").select("family_id").distinct(), "family_id", 7, 2, 1000)


@query("start_grid", ["members_v"], """
    l as (select family_id, member_id, case when n_frames - 1 - 512 < 0 then n_frames - 1 else n_frames - 1 - 512 end as last from members_v where is_trajectory),
    g as (select family_id, member_id, case when last <= 0 then [0] else list_distinct(list_transform(range(0, 5), lambda i: cast(round_even(i * (last / 4.0), 0) as int))) end as g from l)
    select family_id, member_id, unnest(g) as start from g""")
def start_grid(spark, d):
    return W.start_grid(view(spark, d, "members_v"), 5, 512)


@query("lag_pairs", ["trajectory_v"], """
    i as (select *, row_number() over (partition by replica order by frame_idx) - row_number() over (partition by replica, segment order by frame_idx) as i from trajectory_v),
    p as (select replica, frame_idx, segment, i, value, lead(value, 2) over w as later, lead(segment, 2) over w as s, lead(i, 2) over w as j from i window w as (partition by replica order by frame_idx))
    select replica, frame_idx, value, later from p where s = segment and i = j""")
def lag_pairs(spark, d):
    return W.lag_pairs(view(spark, d, "trajectory_v"), 2)


@query("rolling_mean", ["trajectory_v"], "select replica, frame_idx, round(avg(value) over (partition by replica order by frame_idx rows between 9 preceding and current row), 6) as mean from trajectory_v")
def rolling_mean(spark, d):
    return rounded(W.rolling_mean(view(spark, d, "trajectory_v"), "replica", "frame_idx", "value", 10), "mean")


@query("label_runs", ["trajectory_v"], """
    i as (select *, row_number() over (partition by replica order by frame_idx) - row_number() over (partition by replica, segment order by frame_idx) as i from trajectory_v)
    select replica, segment, min(frame_idx) as first, max(frame_idx) as last, count(*) as n from i group by replica, segment, i""")
def label_runs(spark, d):
    return W.label_runs(view(spark, d, "trajectory_v"), "replica", "frame_idx", "segment")


@query("zscore_tail", ["trajectory_v"], """
    s as (select replica, avg(value) as m, stddev_pop(value) as s from trajectory_v where frame_idx >= 20 group by replica)
    select t.replica, frame_idx, round((value - coalesce(m, 0)) / case when coalesce(s, 0) > 0 then s else 1 end, 6) as z from trajectory_v t left join s using (replica)""")
def zscore_tail(spark, d):
    return rounded(W.zscore_tail(view(spark, d, "trajectory_v"), "replica", "frame_idx", "value", 20), "z")


_T = [i / 4 - 1 for i in range(9)]
_P3 = [0.5 * (5 * x**3 - 3 * x) for x in _T]


@query("odd_features", ["trajectory_v"], f"""
    w as (select replica, frame_idx as start, list(value) over (partition by replica order by frame_idx rows between current row and 8 following) as v from trajectory_v),
    x as (select *, list_transform(range(1, 9), lambda i: (v[i + 1] - v[i]) * (v[i + 1] - v[i])) as dd from w where len(v) = 9)
    select replica, start, round(list_dot_product(v, {_T}) / {sum(x * x for x in _T)}, 4) as legendre1, round(list_dot_product(v, {_P3}) / {sum(x * x for x in _P3)}, 4) as legendre3,
      round(list_var_pop(v[6:9]) - list_var_pop(v[1:4]), 8) as var_drift, round(list_avg(dd[5:8]) - list_avg(dd[1:4]), 8) as rough_asym,
      round((list_avg(list_filter(list_transform(range(1, 10), lambda i: case when v[i] = list_max(v) then i end), lambda i: i is not null)) - list_avg(list_filter(list_transform(range(1, 10), lambda i: case when v[i] = list_min(v) then i end), lambda i: i is not null))) / 8, 4) as arg_asym from x""")
def odd_features(spark, d):
    w = W.window_values(view(spark, d, "trajectory_v"), 9)
    features = w.select("replica", "start", *W.odd_features(F.col("values"), 9))
    return rounded(rounded(features, "var_drift", "rough_asym", digits=8), "legendre1", "legendre3", "arg_asym", digits=4)


@query("stride_segments", ["trajectory_v"], """
    n as (select replica, segment, frame_idx, row_number() over (partition by replica, segment order by frame_idx) - 1 as i, count(*) over (partition by replica, segment) as n from trajectory_v)
    select replica, segment, frame_idx from n where i % greatest(1, cast(ceil(n / 8.0) as bigint)) = 0""")
def stride_segments(spark, d):
    by = Window.partitionBy("replica", "segment")
    n = view(spark, d, "trajectory_v").select("replica", "segment", "frame_idx", (F.row_number().over(by.orderBy("frame_idx")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    return n.where(F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / 8.0)) == 0).select("replica", "segment", "frame_idx")


@query("even_subsample", ["trajectory_v"], """
    n as (select replica, count(*) as n from trajectory_v group by replica), k as (select replica, unnest(case when n <= 16 then list_transform(range(0, n), lambda i: cast(i as int)) else list_distinct(list_transform(range(0, 16), lambda i: cast(round_even(i * (n - 1) / 15.0, 0) as int))) end) as frame_idx from n)
    select replica, frame_idx from k""")
def even_subsample(spark, d):
    n = view(spark, d, "trajectory_v").groupBy("replica").agg(F.count("*").alias("n"))
    few = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: i.cast("int"))
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.bround(i * (F.col("n") - 1) / 15.0).cast("int")))
    return n.select("replica", F.explode(F.when(F.col("n") <= 16, few).otherwise(many)).alias("frame_idx"))


@query("split_halves", ["trajectory_v"], """
    n as (select replica, segment, frame_idx, row_number() over (partition by replica, segment order by frame_idx) - 1 as i, count(*) over (partition by replica, segment) as n from trajectory_v),
    h as (select *, i % 2 as half, 'interleaved' as kind from n where i < n - n % 2 union all select *, case when i < n // 2 then 0 else 1 end, 'block' from n where i < n - n % 2)
    select kind, replica, segment, half, count(*) as frames, cast(sum(frame_idx) as bigint) as places from h group by kind, replica, segment, half""")
def split_halves(spark, d):
    """Halves of each segment, by turns or one after the other; an odd frame at the end is dropped."""
    by = Window.partitionBy("replica", "segment")
    n = view(spark, d, "trajectory_v").select("replica", "segment", "frame_idx", (F.row_number().over(by.orderBy("frame_idx")) - 1).alias("i"), F.count("*").over(by).alias("n"))
    kinds = F.array(F.struct(F.lit("interleaved").alias("kind"), (F.col("i") % 2).alias("half")), F.struct(F.lit("block").alias("kind"), F.when(F.col("i") < F.floor(F.col("n") / 2), 0).otherwise(1).alias("half")))
    h = n.where(F.col("i") < F.col("n") - F.col("n") % 2).select("replica", "segment", "frame_idx", F.explode(kinds).alias("h"))
    return h.groupBy("h.kind", "replica", "segment", "h.half").agg(F.count("*").alias("frames"), F.sum("frame_idx").alias("places"))


@query("arrow_cells", ["trajectory_v"], """
    l as (select frame_idx // 10 as bin, s.step, lead(value, s.step) over (partition by replica, s.step order by frame_idx) - value as delta from trajectory_v cross join (select unnest([1, 4]) as step) s)
    select bin, step, count(delta) as n, round(sum(delta), 4) as total, round(sum(delta * delta), 4) as squares from l group by bin, step""")
def arrow_cells(spark, d):
    t = view(spark, d, "trajectory_v")
    by = Window.partitionBy("replica").orderBy("frame_idx")
    own = t.select("frame_idx", "value", *[F.lead("value", k).over(by).alias(f"l{k}") for k in (1, 4)]).select("frame_idx", F.explode(F.array(*[F.struct(F.lit(k).alias("step"), (F.col(f"l{k}") - F.col("value")).alias("delta")) for k in (1, 4)])).alias("x"))
    g = own.groupBy(F.floor(F.col("frame_idx") / 10).alias("bin"), F.col("x.step").alias("step")).agg(F.count("x.delta").alias("n"), F.sum("x.delta").alias("total"), F.sum(F.col("x.delta") * F.col("x.delta")).alias("squares"))
    return rounded(g, "total", "squares", digits=4)


@query("trajectory_check", ["members_v"], "select case when not is_trajectory then 'static' when n_frames < 500 then 'short' else 'ok' end as verdict, count(*) as n from members_v group by 1")
def trajectory_check(spark, d):
    m = view(spark, d, "members_v")
    return m.groupBy(F.when(~F.col("is_trajectory"), "static").when(F.col("n_frames") < 500, "short").otherwise("ok").alias("verdict")).agg(F.count("*").alias("n"))


@query("case_id", ["members_v"], "select concat(cast(family_id as varchar), '__', cast(member_id as varchar), case when is_trajectory then concat('_f', cast(n_frames % 100 as varchar)) else '' end) as id from members_v")
def case_id(spark, d):
    m = view(spark, d, "members_v")
    return m.select(F.concat(F.concat_ws("__", F.col("family_id").cast("string"), F.col("member_id").cast("string")), F.when(F.col("is_trajectory"), F.concat(F.lit("_f"), (F.col("n_frames") % 100).cast("string"))).otherwise("")).alias("id"))


@query("nonoverlap_starts", ["members_v"], """
    l as (select family_id, member_id, n_frames, unnest([1, 8, 64]) as step, unnest([null, 2000, 1500]) as hi from members_v where is_trajectory)
    select family_id, member_id, step, cast(unnest(range(100, least(coalesce(hi, n_frames), n_frames - 8 * step), 8 * step)) as int) as start from l""")
def nonoverlap_starts(spark, d):
    """Starts from 100 up to a bin's end whose windows share no inner frame."""
    m = view(spark, d, "members_v").where("is_trajectory")
    return _cells(m, lambda step, hi: W.nonoverlap_starts(F.col("n_frames"), step, 9, F.lit(100), hi))


@query("emitted_starts", ["members_v"], """
    l as (select family_id, member_id, n_frames, unnest([1, 8, 64]) as step, unnest([null, 2000, 1500]) as hi from members_v where is_trajectory)
    select family_id, member_id, step, cast(unnest(range(cast(ceil(member_id * 130 / 50.0) * 50 as bigint), least(coalesce(hi, n_frames), n_frames - 8 * step), 50)) as int) as start from l""")
def emitted_starts(spark, d):
    """Starts on the stride's grid from a bin's beginning up to its end, at which a window still fits."""
    m = view(spark, d, "members_v").where("is_trajectory")
    return _cells(m, lambda step, hi: W.emitted_starts(F.col("n_frames"), step, 9, F.col("member_id") * 130, hi, STRIDE))


def _cells(members, starts):
    """Starts of each member for three steps, two of them with a bin's end."""
    cells = W.spread(members.select("family_id", "member_id", "n_frames")).select("family_id", "member_id", "n_frames", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(h).cast("int").alias("hi")) for s, h in ((1, None), (8, 2000), (64, 1500))])).alias("c"))
    return cells.select("family_id", "member_id", F.col("c.step").alias("step"), F.explode(starts(F.col("c.step"), F.col("c.hi"))).alias("start"))
