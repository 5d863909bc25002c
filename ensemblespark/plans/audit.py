"""Queries of the time-arrow audit and of agreement between ensembles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arrow as A
from ..operators import confidence as K
from ..operators import ensembles as E
from .catalogs import rounded
from .trajectories import _P3, _T
from .views import oracle, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Steps of windows, edges of bins of starts.
STEPS, EDGES = [1, 2, 4], [0, 10, 20, 40]


def query(name: str, views: list[str], sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(views, sql)
        return f

    return register


def _series(spark, d):
    """Two observables of each replica: the value and its change since the frame before (0 at the first)."""
    t = view(spark, d, "trajectory_v")
    before = F.lag("value").over(Window.partitionBy("replica").orderBy("frame_idx"))
    both = F.array(F.struct(F.lit(0).alias("obs"), F.col("value").alias("z")), F.struct(F.lit(1).alias("obs"), F.coalesce(F.col("value") - before, F.lit(0.0)).alias("z")))
    return t.select(F.col("replica").alias("unit"), "frame_idx", both.alias("b")).select("unit", "frame_idx", F.explode("b").alias("o")).select("unit", F.col("o.obs").alias("obs"), "frame_idx", F.col("o.z").alias("z"))


WINDOWS = f"""
    o as (select replica as unit, frame_idx, value as z, 0 as obs from trajectory_v union all select replica, frame_idx, coalesce(value - lag(value) over (partition by replica order by frame_idx), 0), 1 from trajectory_v),
    l as (select unit, obs, frame_idx as start, s.step, [z, {", ".join(f"lead(z, {k} * s.step) over w" for k in range(1, 9))}] as v from o cross join (select unnest({STEPS}) as step) s window w as (partition by unit, obs, s.step order by frame_idx)),
    x as (select *, list_transform(range(1, 9), lambda i: (v[i + 1] - v[i]) * (v[i + 1] - v[i])) as dd from l where v[9] is not null),
    m as (select unit, step, start, obs, list_dot_product(v, {_T}) / {sum(x * x for x in _T)} as f1, list_dot_product(v, {_P3}) / {sum(x * x for x in _P3)} as f2, list_var_pop(v[6:9]) - list_var_pop(v[1:4]) as f3, list_avg(dd[5:8]) - list_avg(dd[1:4]) as f4,
      (list_avg(list_filter(list_transform(range(1, 10), lambda i: case when v[i] = list_max(v) then i end), lambda i: i is not null)) - list_avg(list_filter(list_transform(range(1, 10), lambda i: case when v[i] = list_min(v) then i end), lambda i: i is not null))) / 8 as f5 from x)"""


@query("window_matrix", ["trajectory_v"], WINDOWS + """
    select unit, step, start, round(sum((1 + obs) * f1), 4) as legendre1, round(sum((1 + obs) * f2), 4) as legendre3, round(sum((1 + obs) * f3), 7) as var_drift, round(sum((1 + obs) * f4), 7) as rough_asym, round(sum((1 + obs) * f5), 4) as arg_asym from m group by unit, step, start""")
def window_matrix(spark, d):
    """Rows of the design matrix: five features of two observables, the second counted twice here so that five columns hold all ten."""
    x = A.window_matrix(_series(spark, d), STEPS, 9)
    names = ["legendre1", "legendre3", "var_drift", "rough_asym", "arg_asym"]
    out = x.select("unit", "step", "start", *[(F.get("x", F.lit(i)) + 2 * F.get("x", F.lit(5 + i))).alias(n) for i, n in enumerate(names)])
    return rounded(rounded(out, "legendre1", "legendre3", "arg_asym", digits=4), "var_drift", "rough_asym", digits=7)


def _bin(start):
    found = F.lit(EDGES[0])
    for e in EDGES[1:]:
        found = F.when(start >= e, F.lit(e)).otherwise(found)
    return found


@query("discriminant", [])
def discriminant(spark, d):
    """How well each cell, a bin of starts and a step, tells a window from its reversal, on every other family."""
    x = A.window_matrix(_series(spark, d), STEPS, 9)
    cell = F.concat_ws("/", _bin(F.col("start")).cast("string"), F.col("step").cast("string"))
    rows = x.select(cell.alias("cell"), F.concat_ws("|", *[F.col(c).cast("string") for c in ("unit", "step", "start")]).alias("key"), "x", (F.col("unit") % 20 % 2 == 0).alias("train"))
    return rounded(A.discriminant(rows, 200), "accuracy", "separation", "null_q99", "strength", digits=4)


CELLS = """
    l as (select family_id as audit, case when frame_idx >= 40 then 40 when frame_idx >= 20 then 20 when frame_idx >= 10 then 10 else 0 end as start, s.step, lead(value, s.step) over (partition by replica, s.step order by frame_idx) - value as delta from trajectory_v cross join (select unnest([1, 2, 4]) as step) s),
    c as (select audit, start, step, count(delta) as emit, round(abs(sum(delta)) / sqrt(count(delta) * sum(delta * delta)), 6) as strength from l group by audit, start, step),
    cells as (select audit, start, step, emit, coalesce(strength, 0) as strength, case when emit < 40 then 'unestimable' when strength > 0.12 then 'arrowed' else 'clean' end as status from c),
    g as (select audit, a.start, b.step from (select distinct audit, start from cells) a join (select distinct audit, step from cells) b using (audit)),
    e as (select g.audit, g.start as min_start, g.step as max_step, 0.5 * sum(case when status = 'arrowed' then emit * strength else 0 end) / nullif(any_value(total), 0) as contamination, count(c.step) as n_eligible, count(case when status = 'arrowed' then 1 end) as n_arrowed, count(case when status = 'unestimable' and emit > 0 then 1 end) as n_unestimable,
        coalesce(max(case when status = 'arrowed' then strength end), 0) as max_strength, coalesce(sum(emit) / nullif(any_value(total), 0), 0) as emit_share
      from g left join cells c on c.audit = g.audit and c.start >= g.start and c.step <= g.step join (select audit, sum(emit) as total from cells group by audit) t on t.audit = g.audit group by g.audit, g.start, g.step),
    f as (select *, coalesce(contamination <= 0.01 and max_strength <= 0.25, false) as feasible from e), q as (select *, feasible and n_unestimable = 0 as certified from f)"""


def _cells(spark, d):
    """Cells of each family: how many changes a step makes, and how one-sided they are."""
    t = view(spark, d, "trajectory_v")
    by = Window.partitionBy("replica").orderBy("frame_idx")
    led = t.select("family_id", "frame_idx", *[(F.lead("value", s).over(by) - F.col("value")).alias(f"d{s}") for s in STEPS])
    led = led.select("family_id", "frame_idx", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"d{s}").alias("delta")) for s in STEPS])).alias("x"))
    delta = F.col("x.delta")
    c = led.groupBy(F.col("family_id").alias("audit"), _bin(F.col("frame_idx")).alias("start"), F.col("x.step").alias("step")).agg(F.count(delta).alias("emit"), F.round(F.abs(F.sum(delta)) / F.sqrt(F.count(delta) * F.sum(delta * delta)), 6).alias("strength"))
    status = F.when(F.col("emit") < 40, "unestimable").when(F.col("strength") > 0.12, "arrowed").otherwise("clean")
    return c.select("audit", "start", "step", "emit", F.coalesce("strength", F.lit(0.0)).alias("strength"), status.alias("status"))


@query("gate_grid", ["trajectory_v"], CELLS + " select audit, min_start, max_step, round(contamination, 6) as contamination, n_eligible, n_arrowed, n_unestimable, max_strength, round(emit_share, 6) as emit_share, feasible, certified from q")
def gate_grid(spark, d):
    """Every gate of each family's audit: what it lets through and how much of that is contaminated."""
    return rounded(A.gate_grid(_cells(spark, d)), "contamination", "emit_share")


@query("gate_search", ["trajectory_v"], CELLS + """,
    r as (select *, row_number() over (partition by audit order by certified desc, emit_share desc, min_start, max_step desc) as rn, count(case when feasible then 1 end) over (partition by audit) as f from q)
    select audit, case when certified then min_start end as min_start, case when certified then max_step end as max_step, certified, case when certified then round(emit_share, 6) end as emit_share, case when certified then round(contamination, 6) end as contamination,
      case when certified then 'certified' when f > 0 then concat(f, ' feasible, none without unestimable cells') else 'none feasible' end as reason from r where rn = 1""")
def gate_search(spark, d):
    """The least restrictive certified gate of each family, or why there is none."""
    return rounded(A.gate_search(A.gate_grid(_cells(spark, d))), "emit_share", "contamination")


LDDT = """
    n as (select ensemble_id, count(distinct frame_idx) as n from frames_v group by ensemble_id), c as (select concat(ensemble_id, '-', 0) as name, ensemble_id as a, 0 as b from n),
    k as (select name, a, b, x.n as na, y.n as nb, unnest(range(0, 40)) as k from c join n x on x.ensemble_id = a join n y on y.ensemble_id = b),
    h as (select *, ('0x' || substr(sha256('5|' || name || '|a|' || k), 1, 12))::bigint as ha, ('0x' || substr(sha256('5|' || name || '|b|' || k), 1, 12))::bigint as hb from k),
    w as (select name, k, a, b, ha % na as fa, case when a = b then (ha % na + 1 + hb % (na - 1)) % na else hb % nb end as fb from h),
    d as (select p.ensemble_id as e, p.frame_idx as f, p.res_idx as i, q.res_idx as j, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) as d from frames_v p join frames_v q on p.ensemble_id = q.ensemble_id and p.frame_idx = q.frame_idx and p.res_idx <> q.res_idx),
    s as (select name, k, x.i, (abs(x.d - y.d) < 0.5)::int + (abs(x.d - y.d) < 1)::int + (abs(x.d - y.d) < 2)::int + (abs(x.d - y.d) < 4)::int as kept, (x.d < 15)::int as ia, (y.d < 15)::int as ib from w join d x on x.e = a and x.f = fa join d y on y.e = b and y.f = fb and x.i = y.i and x.j = y.j),
    v as (select name, k, i, (coalesce(sum(kept / 4.0 * ia) / nullif(sum(ia), 0), 0) + coalesce(sum(kept / 4.0 * ib) / nullif(sum(ib), 0), 0)) / 2 as s from s group by name, k, i)
    select name as "case", i as res_idx, round(avg(s), 6) as lddt, round(stddev_pop(s), 6) as sd, count(*) as n from v group by name, i"""


@query("cross_lddt", ["frames_v"], LDDT)
def cross_lddt(spark, d):
    """Each ensemble against the reference, and the reference against itself, over 40 pairs of frames."""
    rows = E.flat(view(spark, d, "frames_v"))
    cases = rows.select("ensemble_id").distinct().select(F.concat("ensemble_id", F.lit("-0")).alias("case"), F.col("ensemble_id").alias("a"), F.lit(0).alias("b"))
    return rounded(K.cross_lddt(rows, cases, 40, 5), "lddt", "sd")
