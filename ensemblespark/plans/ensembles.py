"""Queries over ensembles of frames and over metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import ensembles as E
from ..sinks import keep
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


PAIRS = "d as (select a.ensemble_id, a.frame_idx, a.res_idx as i, b.res_idx as j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) as d from frames_v a join frames_v b on a.ensemble_id = b.ensemble_id and a.frame_idx = b.frame_idx and b.res_idx > a.res_idx)"


@query("rmsf", ["frames_v"], "select ensemble_id, res_idx, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) as rmsf from frames_v group by ensemble_id, res_idx")
def rmsf(spark, d):
    return rounded(E.rmsf(view(spark, d, "frames_v")), "rmsf")


@query("gyration", ["frames_v"], "select ensemble_id, frame_idx, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) as rg from frames_v group by ensemble_id, frame_idx")
def gyration(spark, d):
    return rounded(E.gyration(view(spark, d, "frames_v")), "rg")


@query("atom_covariance", ["frames_v"], """
    select ensemble_id, res_idx, round(avg(x), 6) as mx, round(avg(y), 6) as my, round(avg(z), 6) as mz, round(covar_pop(x, x), 6) as cxx, round(covar_pop(x, y), 6) as cxy, round(covar_pop(x, z), 6) as cxz,
      round(covar_pop(y, y), 6) as cyy, round(covar_pop(y, z), 6) as cyz, round(covar_pop(z, z), 6) as czz from frames_v group by ensemble_id, res_idx""")
def atom_covariance(spark, d):
    c = E.covariance(view(spark, d, "frames_v"))
    return rounded(c, *c.columns[2:])


@query("effective_dim", ["frames_v"], """
    l as (select ensemble_id, frame_idx, 3 * res_idx as k, x as v from frames_v union all select ensemble_id, frame_idx, 3 * res_idx + 1, y from frames_v union all select ensemble_id, frame_idx, 3 * res_idx + 2, z from frames_v),
    c as (select a.ensemble_id, a.k = b.k as own, covar_pop(a.v, b.v) as cv from l a join l b on a.ensemble_id = b.ensemble_id and a.frame_idx = b.frame_idx group by a.ensemble_id, a.k, b.k)
    select ensemble_id, round(pow(sum(case when own then cv end), 2) / sum(cv * cv), 6) as dim from c group by ensemble_id""")
def effective_dim(spark, d):
    return rounded(E.effective_dim(view(spark, d, "frames_v")), "dim")


@query("rmsf_summary", ["frames_v"], """
    r as (select ensemble_id, res_idx, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) as r from frames_v group by ensemble_id, res_idx)
    select a.ensemble_id, round(median(a.r), 6) as middle, round(avg(a.r), 6) as mean, round(corr(a.r, b.r), 6) as r from r a join r b on a.res_idx = b.res_idx and b.ensemble_id = 0 where a.ensemble_id <> 0 group by a.ensemble_id""")
def rmsf_summary(spark, d):
    r = E.rmsf(view(spark, d, "frames_v"))
    ref = r.where("ensemble_id = 0").select("res_idx", F.col("rmsf").alias("ref"))
    g = r.where("ensemble_id <> 0").join(ref, "res_idx").groupBy("ensemble_id").agg(F.median("rmsf").alias("middle"), F.avg("rmsf").alias("mean"), F.corr("rmsf", "ref").alias("r"))
    return rounded(g, "middle", "mean", "r")


@query("residue_pairs", ["frames_v"], PAIRS + " select ensemble_id, i, j, count(*) as n, round(avg(d), 6) as mean from d where j - i >= 3 group by ensemble_id, i, j")
def residue_pairs(spark, d):
    return rounded(E.pair_distances(view(spark, d, "frames_v"), 3).groupBy("ensemble_id", "i", "j").agg(F.count("*").alias("n"), F.avg("d").alias("mean")), "mean")


@query("contact_probability", ["frames_v"], PAIRS + " select ensemble_id, i, j, round(avg(case when d < 8 then 1.0 else 0.0 end), 6) as p from d where j - i >= 3 group by ensemble_id, i, j")
def contact_probability(spark, d):
    return rounded(E.contact_probability(view(spark, d, "frames_v")), "p")


@query("distance_variance", ["frames_v"], PAIRS + " select ensemble_id, i, j, round(var_pop(d), 6) as v from d group by ensemble_id, i, j")
def distance_variance(spark, d):
    return rounded(E.distance_variance(view(spark, d, "frames_v")), "v")


@query("contact_jaccard", ["frames_v"], PAIRS + """,
    p as (select ensemble_id, i, j, avg(case when d < 8 then 1.0 else 0.0 end) as p from d group by ensemble_id, i, j),
    n as (select i, j, d < 8 as native from d where ensemble_id = 0 and frame_idx = 0),
    c as (select b.ensemble_id, n.native, a.p as pa, b.p as pb from p a join p b on a.i = b.i and a.j = b.j and a.ensemble_id = 0 and b.ensemble_id <> 0 join n on n.i = a.i and n.j = a.j)
    select ensemble_id, round(sum(case when native and pa < 0.9 and pb < 0.9 then 1 else 0 end) / nullif(sum(case when native and (pa < 0.9 or pb < 0.9) then 1 else 0 end), 0), 6) as weak,
      round(sum(case when not native and pa > 0.1 and pb > 0.1 then 1 else 0 end) / nullif(sum(case when not native and (pa > 0.1 or pb > 0.1) then 1 else 0 end), 0), 6) as transient from c group by ensemble_id""")
def contact_jaccard(spark, d):
    """Contacts of all pairs of points, whatever their distance along the chain."""
    f = view(spark, d, "frames_v")
    p = E.contact_probability(f, sep=1)
    native = E.pair_distances(f.where("ensemble_id = 0 and frame_idx = 0"), 1).select("i", "j", (F.col("d") < 8).alias("native"))
    return rounded(E.contact_jaccard(p.where("ensemble_id = 0"), p.where("ensemble_id <> 0"), native), "weak", "transient")


@query("bond_clash", ["frames_v"], PAIRS + " select ensemble_id, round(avg(case when j = i + 1 then case when d < 3.5 or d > 4.2 then 1.0 else 0.0 end end), 6) as bond, round(avg(case when j >= i + 3 then case when d < 3.5 then 1.0 else 0.0 end end), 6) as clash from d group by ensemble_id")
def bond_clash(spark, d):
    return rounded(E.bond_clash(view(spark, d, "frames_v")), "bond", "clash")


@query("validity_status", ["frames_v"], PAIRS + """,
    b as (select ensemble_id, avg(case when j = i + 1 then case when d < 3.5 or d > 4.2 then 1.0 else 0.0 end end) as bond, avg(case when j >= i + 3 then case when d < 3.5 then 1.0 else 0.0 end end) as clash from d group by ensemble_id),
    r as (select bond, clash from b where ensemble_id = 0)
    select ensemble_id, case when b.bond >= 0.25 then 'void' when b.bond >= greatest(0.05, 10 * coalesce(r.bond, 0)) or b.clash - coalesce(r.clash, 0) >= 0.01 then 'flagged' else 'ok' end as status from b, r""")
def validity_status(spark, d):
    b = E.bond_clash(view(spark, d, "frames_v"))
    ref = F.broadcast(b.where("ensemble_id = 0").select(F.col("bond").alias("rb"), F.col("clash").alias("rc")))  # one row
    return b.join(ref).select("ensemble_id", E.validity(F.col("bond"), F.col("clash"), F.col("rb"), F.col("rc")).alias("status"))


def _bin(v: str, lo: str, hi: str, bins: int) -> str:
    return f"case when {v} = {hi} then {bins - 1} when floor(({v} - {lo}) / (({hi} - {lo}) / {bins})) between 0 and {bins - 1} then cast(floor(({v} - {lo}) / (({hi} - {lo}) / {bins})) as int) end"


OTHERS = "e as (select distinct ensemble_id as e from frames_v where ensemble_id <> 0)"


def _sides(rows, *keys):
    """Rows of all other ensembles, and the reference's once for each of them."""
    ids = rows.select("ensemble_id").distinct().where("ensemble_id <> 0")
    channel = F.struct("ensemble_id", *keys).alias("channel")
    ref = rows.where("ensemble_id = 0").drop("ensemble_id").crossJoin(F.broadcast(ids))  # a row per ensemble
    rest = [c for c in rows.columns if c not in ("ensemble_id", *keys)]
    return rows.where("ensemble_id <> 0").select(channel, *rest), ref.select(channel, *rest)


@query("js_hist", ["frames_v"], OTHERS + f""",
    s as (select res_idx, min(x) as lo, max(x) as hi from frames_v where ensemble_id = 0 group by res_idx),
    v as (select f.res_idx, ensemble_id, {_bin('x', 'lo', 'hi', 50)} as bin from frames_v f join s using (res_idx)), n0 as (select ensemble_id, res_idx, bin, count(*) as n from v group by ensemble_id, res_idx, bin),
    g as (select e, res_idx, unnest(range(0, 50)) as bin from s cross join e),
    c as (select g.e, g.res_idx, g.bin, coalesce(a.n, 0) + 1e-6 as r, coalesce(b.n, 0) + 1e-6 as q from g left join n0 a on a.ensemble_id = 0 and a.res_idx = g.res_idx and a.bin = g.bin left join n0 b on b.ensemble_id = g.e and b.res_idx = g.res_idx and b.bin = g.bin),
    n as (select e, res_idx, bin, r / sum(r) over (partition by e, res_idx) as p, q / sum(q) over (partition by e, res_idx) as q from c),
    i as (select ensemble_id as e, res_idx, avg(case when bin is not null then 1.0 else 0.0 end) as inside from v group by ensemble_id, res_idx)
    select n.e as ensemble_id, n.res_idx, round(sqrt(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2), 5) as js, round(any_value(inside), 6) as inside from n join i using (e, res_idx) group by n.e, n.res_idx""")
def js_hist(spark, d):
    f = view(spark, d, "frames_v").select("ensemble_id", "res_idx", "x")
    return rounded(rounded(E.js_against(f.where("ensemble_id = 0").drop("ensemble_id"), f.where("ensemble_id <> 0"), "ensemble_id", ["res_idx"], "x"), "js", digits=5), "inside")


@query("hist_overlap", ["frames_v"], OTHERS + f""",
    f as (select e, res_idx, x, ensemble_id <> 0 as own from frames_v join e on ensemble_id in (0, e)), s as (select e, res_idx, min(x) as lo, max(x) as hi, count(case when not own then 1 end) as n0, count(case when own then 1 end) as n1 from f group by e, res_idx),
    c as (select f.e, f.res_idx, {_bin('x', 'lo', 'hi', 40)} as bin, any_value(n0) as n0, any_value(n1) as n1, count(case when not own then 1 end) as a, count(case when own then 1 end) as b from f join s using (e, res_idx) group by f.e, f.res_idx, bin)
    select e as ensemble_id, res_idx, round(sum(least(a / n0, b / n1)), 6) as overlap from c group by e, res_idx""")
def hist_overlap(spark, d):
    f = view(spark, d, "frames_v").select("ensemble_id", "res_idx", "x")
    return rounded(E.overlap_against(f.where("ensemble_id = 0").drop("ensemble_id"), f.where("ensemble_id <> 0"), "ensemble_id", ["res_idx"], "x"), "overlap")


def overlaps(sep: int) -> str:
    """SQL of the overlap o of each pair's distances in ensemble e and the reference."""
    return PAIRS + ", " + OTHERS + f""",
    f as (select e, i, j, i * 100 + j as pair, d, ensemble_id <> 0 as own from d join e on ensemble_id in (0, e) where j - i >= {sep}), s as (select e, pair, min(d) as lo, max(d) as hi, count(case when not own then 1 end) as n0, count(case when own then 1 end) as n1 from f group by e, pair),
    c as (select f.e, i, j, {_bin('d', 'lo', 'hi', 40)} as bin, any_value(n0) as n0, any_value(n1) as n1, count(case when not own then 1 end) as a, count(case when own then 1 end) as b from f join s using (e, pair) group by f.e, i, j, bin),
    o as (select e, i, j, sum(least(a / n0, b / n1)) as o from c group by e, i, j), b2 as (select e, i, j, o from o union all select e, j, i, o from o)"""


def _pair_overlaps(spark, d, sep: int):
    """(ensemble_id, i, j, overlap), both ways, of each pair's distances in an ensemble and the reference."""
    p = keep(E.pair_distances(view(spark, d, "frames_v"), sep).select("ensemble_id", "i", "j", "d"))
    o = E.overlap_against(p.where("ensemble_id = 0").drop("ensemble_id"), p.where("ensemble_id <> 0"), "ensemble_id", ["i", "j"], "d")
    return o.unionByName(o.select("ensemble_id", F.col("j").alias("i"), F.col("i").alias("j"), "overlap"))


@query("residue_confidence", ["frames_v"], overlaps(6) + " select e as ensemble_id, i, round(100 * avg(o), 5) as confidence from b2 group by e, i")
def residue_confidence(spark, d):
    o = _pair_overlaps(spark, d, 6)
    return rounded(o.groupBy("ensemble_id", "i").agg((100 * F.avg("overlap")).alias("confidence")), "confidence", digits=5)


NEAR = "n as (select ensemble_id, i, j from d where j - i >= 3 group by ensemble_id, i, j having median(d) <= 30), k as (select ensemble_id, i, j from n union all select ensemble_id, j, i from n)"


@query("neighbour_union", ["frames_v"], PAIRS + ", " + OTHERS + ", " + NEAR + " select e as ensemble_id, i, count(distinct j) as n from k join e on ensemble_id in (0, e) group by e, i")
def neighbour_union(spark, d):
    """How many points are near each point in an ensemble or in the reference."""
    return _neighbours(spark, d).groupBy("ensemble_id", "i").agg(F.count("*").alias("n"))


def _neighbours(spark, d):
    own, ref = _sides(E.local_neighbours(view(spark, d, "frames_v"), 30.0), "i", "j")
    return own.union(ref).distinct().select("channel.*")


@query("local_confidence", ["frames_v"], overlaps(3) + ", " + NEAR + ", u as (select distinct e, i, j from k join e on ensemble_id in (0, e)) select u.e as ensemble_id, u.i, round(100 * avg(o), 5) as confidence, count(*) as n from u join b2 using (e, i, j) group by u.e, u.i")
def local_confidence(spark, d):
    """Agreement of an ensemble with the reference on each point's neighbourhood, that of either, and its size; points without
    neighbours are left out."""
    o = _neighbours(spark, d).join(_pair_overlaps(spark, d, 3), ["ensemble_id", "i", "j"])
    return rounded(o.groupBy("ensemble_id", "i").agg((100 * F.avg("overlap")).alias("confidence"), F.count("*").alias("n")), "confidence", digits=5)


@query("agreement_ceiling", ["frames_v"], PAIRS + f""",
    f as (select ensemble_id as e, i * 100 + j as pair, d, frame_idx % 2 = 1 as own from d where j - i >= 6), s as (select e, pair, min(d) as lo, max(d) as hi, count(case when not own then 1 end) as n0, count(case when own then 1 end) as n1 from f group by e, pair),
    c as (select f.e, pair, {_bin('d', 'lo', 'hi', 40)} as bin, any_value(n0) as n0, any_value(n1) as n1, count(case when not own then 1 end) as a, count(case when own then 1 end) as b from f join s using (e, pair) group by f.e, pair, bin),
    o as (select e, pair, sum(least(a / greatest(n0, 1), b / greatest(n1, 1))) as o from c group by e, pair)
    select e as ensemble_id, round(100 * avg(o), 5) as ceiling from o group by e""")
def agreement_ceiling(spark, d):
    """How well the two halves of an ensemble agree, which no comparison with another can be expected to exceed."""
    p = E.pair_distances(view(spark, d, "frames_v"), 6).select(F.struct("ensemble_id", "i", "j").alias("channel"), "d", (F.col("frame_idx") % 2).alias("half"))
    o = E.hist_overlap(p.where("half = 0"), p.where("half = 1"), "channel", "d")
    return rounded(o.groupBy("channel.ensemble_id").agg((100 * F.avg("overlap")).alias("ceiling")), "ceiling", digits=5)


@query("scalar_agreement", ["frames_v"], OTHERS + f""",
    g as (select ensemble_id, frame_idx, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) as v from frames_v group by ensemble_id, frame_idx), f as (select e, v, ensemble_id <> 0 as own from g join e on ensemble_id in (0, e)),
    s as (select e, min(v) as lo, max(v) as hi, count(case when not own then 1 end) as n0, count(case when own then 1 end) as n1, avg(case when own then v end) as mean, stddev_pop(case when own then v end) as sd, avg(case when not own then v end) as ref_mean, stddev_pop(case when not own then v end) as ref_sd from f group by e),
    c as (select f.e, {_bin('v', 'lo', 'hi', 40)} as bin, count(case when not own then 1 end) / any_value(n0) as a, count(case when own then 1 end) / any_value(n1) as b from f join s using (e) group by f.e, bin), o as (select e, sum(least(a, b)) as o from c group by e)
    select e as ensemble_id, round(o, 6) as overlap, round(mean, 6) as mean, round(sd, 6) as sd, round(ref_mean, 6) as ref_mean, round(ref_sd, 6) as ref_sd from o join s using (e)""")
def scalar_agreement(spark, d):
    """Radii of gyration of an ensemble's frames against the reference's: overlap, means and deviations."""
    own, ref = _sides(E.gyration(view(spark, d, "frames_v")).select("ensemble_id", "rg"))
    stats = lambda rows, p: rows.groupBy("channel").agg(F.avg("rg").alias(f"{p}mean"), F.stddev_pop("rg").alias(f"{p}sd"))
    o = E.hist_overlap(ref, own, "channel", "rg").join(stats(own, ""), "channel").join(stats(ref, "ref_"), "channel")
    return rounded(o.select("channel.ensemble_id", "overlap", "mean", "sd", "ref_mean", "ref_sd"), "overlap", "mean", "sd", "ref_mean", "ref_sd")


@query("matrix_rank_corr", ["frames_v"], PAIRS + """,
    m as (select ensemble_id, i, j, round(avg(d), 9) as a from d group by ensemble_id, i, j), p as (select m.ensemble_id, m.a, r.a as b from m join m r on r.ensemble_id = 0 and m.ensemble_id <> 0 and m.i = r.i and m.j = r.j),
    r as (select ensemble_id, rank() over (partition by ensemble_id order by a) + (count(*) over (partition by ensemble_id, a) - 1) / 2.0 as ra, rank() over (partition by ensemble_id order by b) + (count(*) over (partition by ensemble_id, b) - 1) / 2.0 as rb from p)
    select ensemble_id, round(corr(ra, rb), 6) as rho from r group by ensemble_id""")
def matrix_rank_corr(spark, d):
    m = E.pair_distances(view(spark, d, "frames_v"), 1).groupBy("ensemble_id", "i", "j").agg(F.round(F.avg("d"), 9).alias("a"))
    ref = m.where("ensemble_id = 0").select("i", "j", F.col("a").alias("b"))
    return rounded(E.spearman(m.where("ensemble_id <> 0").join(ref, ["i", "j"]), "a", "b", ["ensemble_id"]), "rho")


@query("gap_check", ["frames_v"], PAIRS + " select ensemble_id, frame_idx, count(*) as gaps from d where j = i + 1 and d > 10 group by ensemble_id, frame_idx")
def gap_check(spark, d):
    p = E.pair_distances(view(spark, d, "frames_v"), 1)
    return p.where((F.col("j") == F.col("i") + 1) & (F.col("d") > 10)).groupBy("ensemble_id", "frame_idx").agg(F.count("*").alias("gaps"))


@query("quantise_coords", ["frames_v"], "s as (select ensemble_id, max(greatest(abs(x), abs(y), abs(z))) as m from frames_v group by ensemble_id) select f.ensemble_id, frame_idx, res_idx, cast(round(x * 32000 / m) as smallint) as qx from frames_v f join s using (ensemble_id)")
def quantise_coords(spark, d):
    f = view(spark, d, "frames_v")
    s = f.groupBy("ensemble_id").agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))).alias("m"))
    return f.join(s, "ensemble_id").select("ensemble_id", "frame_idx", "res_idx", F.round(F.col("x") * 32000 / F.col("m")).cast("smallint").alias("qx"))


@query("common_residues", ["frames_v"], "n as (select count(distinct ensemble_id) as n from frames_v) select res_idx from frames_v group by res_idx having count(distinct ensemble_id) = (select n from n)")
def common_residues(spark, d):
    f = view(spark, d, "frames_v").select("ensemble_id", "res_idx").distinct()
    n = F.broadcast(f.agg(F.countDistinct("ensemble_id").alias("n")))
    return f.groupBy("res_idx").agg(F.count("*").alias("k")).join(n, F.col("k") == F.col("n")).select("res_idx")


LONG = "l as (select arm, family, seed, unnest(['price', 'discount', 'tax_r']) as metric, unnest([price, discount, tax]) as value from arms_v)"


def _long(spark, d):
    a = view(spark, d, "arms_v")
    return a.unpivot(["arm", "family", "seed"], ["price", "discount", "tax"], "metric", "value").withColumn("metric", F.when(F.col("metric") == "tax", "tax_r").otherwise(F.col("metric")))


@query("seed_average", ["arms_v"], LONG + " select arm, family, metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, count(*) as n from l group by arm, family, metric")
def seed_average(spark, d):
    return rounded(_long(spark, d).groupBy("arm", "family", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")), "mean", "sd")


@query("paired_arms", ["arms_v"], LONG + """,
    m as (select arm, family, metric, avg(value) as v from l group by arm, family, metric)
    select a.family, a.metric, round(case when a.metric like '%\\_r' escape '\\' then atanh(a.v) - atanh(b.v) else ln(a.v / b.v) end, 6) as diff, a.metric like '%\\_r' escape '\\' as higher from m a join m b on a.family = b.family and a.metric = b.metric where a.arm = 'A' and b.arm = 'N'""")
def paired_arms(spark, d):
    m = _long(spark, d).groupBy("arm", "family", "metric").agg(F.avg("value").alias("v"))
    a, b = m.where("arm = 'A'").select("family", "metric", F.col("v").alias("a")), m.where("arm = 'N'").select("family", "metric", F.col("v").alias("b"))
    return rounded(a.join(b, ["family", "metric"]).select("family", "metric", X.paired_difference(F.col("metric"), F.col("a"), F.col("b")).alias("diff"), X.higher_is_better(F.col("metric")).alias("higher")), "diff")


@query("floor_join", ["arms_v"], LONG + """,
    f as (select family, metric, avg(value) as m, stddev_samp(value) as s from l where arm = 'R' group by family, metric)
    select l.arm, l.family, l.seed, l.metric, round(case when s > 0 then (value - m) / s end, 5) as z from l left join f using (family, metric) where l.arm <> 'R'""")
def floor_join(spark, d):
    l = _long(spark, d)
    f = l.where("arm = 'R'").groupBy("family", "metric").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return rounded(l.where("arm <> 'R'").join(f, ["family", "metric"], "left").select("arm", "family", "seed", "metric", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).alias("z")), "z", digits=5)


@query("floor_spread", ["arms_v"], LONG + """, m as (select family, metric, avg(value) as m, stddev_samp(value) as sd from l where arm = 'R' group by family, metric),
    f as (select metric, case when ends_with(metric, '_r') then case when abs(m) < 1 then sd / greatest(1e-12, 1 - m * m) end when m > 0 then sd / m end as s from m)
    select metric, round(median(s), 6) as spread from f where s is not null group by metric""")
def floor_spread(spark, d):
    """A metric's spread in the floor: the median over families of sd / mean, for correlations of sd / (1 - mean^2)."""
    f = _long(spark, d).where("arm = 'R'").groupBy("family", "metric").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    s = F.when(F.col("metric").endswith("_r"), F.when(F.abs("m") < 1, F.col("sd") / F.greatest(F.lit(1e-12), 1 - F.col("m") ** 2))).when(F.col("m") > 0, F.col("sd") / F.col("m"))
    return rounded(f.select("metric", s.alias("s")).where("s is not null").groupBy("metric").agg(F.median("s").alias("spread")), "spread")


@query("rank_checkpoints", ["arms_v"], LONG + ", m as (select seed, metric, avg(value) as v from l group by seed, metric) select metric, seed, cast(row_number() over (partition by metric order by case when metric like '%\\_r' escape '\\' then -v else v end, seed) as bigint) as place from m")
def rank_checkpoints(spark, d):
    from pyspark.sql import Window

    m = _long(spark, d).groupBy("seed", "metric").agg(F.avg("value").alias("v"))
    key = F.when(X.higher_is_better(F.col("metric")), -F.col("v")).otherwise(F.col("v"))
    return m.select("metric", "seed", F.row_number().over(Window.partitionBy("metric").orderBy(key, "seed")).cast("long").alias("place"))


@query("metric_registry", ["arms_v"], """
    r as (select price, tax, rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0 as rp, rank() over (order by tax) + (count(*) over (partition by tax) - 1) / 2.0 as rt from arms_v), s as (select corr(rp, rt) as spearman from r)
    select round(avg(price - 38000), 4) as bias, round(avg(abs(price - 38000)), 4) as mae, round(avg((price - 38000) * (price - 38000)), 2) as mse, round(min(price), 4) as low, round(max(price), 4) as high, round(corr(price, tax), 6) as pearson, round(regr_r2(price, tax), 6) as r2,
      round(sum(price * seed) / sum(seed), 4) as weighted, round(any_value(spearman), 6) as spearman from arms_v, s""")
def metric_registry(spark, d):
    """Metrics by name, each an aggregate."""
    e = F.col("price") - 38000
    registry = {
        "bias": F.round(F.avg(e), 4), "mae": F.round(F.avg(F.abs(e)), 4), "mse": F.round(F.avg(e * e), 2), "low": F.round(F.min("price"), 4), "high": F.round(F.max("price"), 4), "pearson": F.round(F.corr("price", "tax"), 6),
        "r2": F.round(F.regr_r2("price", "tax"), 6), "weighted": F.round(F.sum(F.col("price") * F.col("seed")) / F.sum("seed"), 4),
    }
    a = view(spark, d, "arms_v")
    ranks = E.spearman(a, "price", "tax").select(F.round("rho", 6).alias("spearman"))
    return a.agg(*[c.alias(n) for n, c in registry.items()]).crossJoin(ranks)  # one row each
