"""Queries that compare ensembles with a reference ensemble, and the statistics of such comparisons.

The reference is ensemble 0; its first frame is the reference structure. All others are held against it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import power
from ..operators import ensembles as E
from .catalogs import rounded
from .ensembles import NEAR, PAIRS
from .records import PAIRED, _paired
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


def _first(frames) -> list[float]:
    """The reference structure: one row, as long as a frame."""
    row = E.flat(frames.where("ensemble_id = 0 and frame_idx = 0")).select("v").first()
    return list(row.v) if row else []


@query("apply_rigid", ["frames_v"], """
    select ensemble_id, frame_idx, res_idx, round(x * cos(frame_idx * 0.1) - y * sin(frame_idx * 0.1) + ensemble_id, 6) as x, round(x * sin(frame_idx * 0.1) + y * cos(frame_idx * 0.1) - 1, 6) as y, round(z + frame_idx * 0.5, 6) as z from frames_v""")
def apply_rigid(spark, d):
    """Every point of a frame by that frame's own rotation and shift."""
    f = view(spark, d, "frames_v")
    c, s, zero, one = F.cos(F.col("frame_idx") * 0.1), F.sin(F.col("frame_idx") * 0.1), F.lit(0.0), F.lit(1.0)
    moves = f.select("ensemble_id", "frame_idx").distinct().select("ensemble_id", "frame_idx", F.array(c, -s, zero, s, c, zero, zero, zero, one).alias("r"), F.array(F.col("ensemble_id").cast("double"), F.lit(-1.0), F.col("frame_idx") * 0.5).alias("t"))
    return rounded(E.apply_rigid(f, moves), "x", "y", "z")


@query("kabsch", [])
def kabsch(spark, d):
    """Every frame superposed onto the reference structure: the distance left, and the rotation's determinant."""
    f = view(spark, d, "frames_v")
    return rounded(E.superposed(E.flat(f), _first(f)).select("ensemble_id", "frame_idx", "rmsd", "det"), "rmsd", "det")


RMSD = """f as (select ensemble_id, frame_idx, res_idx, x, y, z from frames_v),
    p as (select a.ensemble_id, a.frame_idx as i, b.frame_idx as j, sqrt(sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / count(*)) as d from f a join f b on a.ensemble_id = b.ensemble_id and a.res_idx = b.res_idx group by a.ensemble_id, a.frame_idx, b.frame_idx)"""


@query("frame_pair_rmsd", ["frames_v"], RMSD + " select ensemble_id, i as frame_idx, round(sum(d), 5) as total, count(*) as n from p group by ensemble_id, i")
def frame_pair_rmsd(spark, d):
    """Each frame's distances to all frames of its ensemble, summed up."""
    rows = E.flat(view(spark, d, "frames_v")).withColumn("label", F.lit("all"))
    return rounded(E.frame_distances(rows).select("ensemble_id", "frame_idx", "total", "n"), "total", digits=5)


@query("pairwise_rmsd_mean", ["frames_v"], RMSD + """,
    c as (select a.ensemble_id, a.frame_idx as i, b.frame_idx as j, sqrt(sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / count(*)) as d from f a join f b on b.ensemble_id = 0 and a.ensemble_id <> 0 and a.res_idx = b.res_idx group by a.ensemble_id, a.frame_idx, b.frame_idx),
    s as (select ensemble_id, avg(d) as own, count(distinct i) as n from p group by ensemble_id), x as (select ensemble_id, avg(d) as across from c group by ensemble_id), r as (select own as ref from s where ensemble_id = 0)
    select s.ensemble_id, round(own, 6) as own, round(case when n > 1 then own * n / (n - 1) end, 6) as debiased, round(across, 6) as across, round(abs(own - ref), 6) as error from s left join x using (ensemble_id), r""")
def pairwise_rmsd_mean(spark, d):
    """Mean distance of frames within an ensemble (zero diagonal included, and without its bias), to the reference's frames, and how far the first is from the reference's own."""
    rows = E.flat(view(spark, d, "frames_v")).withColumn("label", F.lit("all"))
    own = E.frame_distances(rows).groupBy("ensemble_id").agg((F.sum("total") / F.sum("n")).alias("own"), F.count("*").alias("n"))
    ids = rows.select("ensemble_id").distinct().where("ensemble_id <> 0")
    ref = rows.where("ensemble_id = 0").drop("ensemble_id").crossJoin(F.broadcast(ids))  # a row per ensemble
    across = E.frame_distances(rows.where("ensemble_id <> 0"), ref).groupBy("ensemble_id").agg((F.sum("total") / F.sum("n")).alias("across"))
    base = own.where("ensemble_id = 0").select(F.col("own").alias("ref"))
    out = own.join(across, "ensemble_id", "left").crossJoin(F.broadcast(base))  # one row
    debiased = F.when(F.col("n") > 1, F.col("own") * F.col("n") / (F.col("n") - 1))
    return rounded(out.select("ensemble_id", "own", debiased.alias("debiased"), "across", F.abs(F.col("own") - F.col("ref")).alias("error")), "own", "debiased", "across", "error")


LABELS = RMSD + ", l as (select i, j, ensemble_id, d, i % 3 as a, j % 3 as b from p)"


@query("medoid", ["frames_v"], LABELS + ", m as (select ensemble_id, a as label, i, round(avg(d), 9) as d from l where a = b group by ensemble_id, a, i) select ensemble_id, cast(label as varchar) as label, arg_min(i, {'d': d, 'i': i}) as frame_idx from m group by ensemble_id, label")
def medoid(spark, d):
    """Of each cluster (every third frame here) the member with the least mean distance to it, the first of several."""
    own = _labelled(spark, d)
    m = E.frame_distances(own).join(own.select("ensemble_id", "frame_idx", "label"), ["ensemble_id", "frame_idx", "label"])
    return m.groupBy("ensemble_id", "label").agg(F.min(F.struct(F.round(F.col("total") / F.col("n"), 9), "frame_idx")).alias("b")).select("ensemble_id", "label", "b.frame_idx")


def _labelled(spark, d):
    return E.flat(view(spark, d, "frames_v")).withColumn("label", (F.col("frame_idx") % 3).cast("string"))


@query("silhouette", ["frames_v"], LABELS + """,
    s as (select ensemble_id, i, a, b, sum(d) as t, count(*) as n from l group by ensemble_id, i, a, b), k as (select ensemble_id, i, max(case when a = b and n > 1 then t / (n - 1) end) as own, min(case when a <> b then t / n end) as other from s group by ensemble_id, i)
    select ensemble_id, round(coalesce(avg(case when own is not null then (other - own) / greatest(own, other) end), 0), 6) as score from k group by ensemble_id""")
def silhouette(spark, d):
    """Mean silhouette of the frames under a clustering (every third frame here); 0 for a single cluster."""
    own = _labelled(spark, d)
    s = E.frame_distances(own).join(own.select("ensemble_id", "frame_idx", F.col("label").alias("mine")), ["ensemble_id", "frame_idx"])
    same = F.col("label") == F.col("mine")
    k = s.groupBy("ensemble_id", "frame_idx").agg(F.max(F.when(same & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("own"), F.min(F.when(~same, F.col("total") / F.col("n"))).alias("other"))
    return rounded(k.groupBy("ensemble_id").agg(F.coalesce(F.avg((F.col("other") - F.col("own")) / F.greatest("own", "other")), F.lit(0.0)).alias("score")), "score")


@query("gaussian_w2", [])
def gaussian_w2(spark, d):
    """Distance of each point's Gaussian from the reference ensemble's: how far the mean moves, and the spread's own distance."""
    c = E.covariance(view(spark, d, "frames_v"))
    return rounded(E.gaussian_w2(c.where("ensemble_id <> 0"), c.where("ensemble_id = 0")), "translation", "variance")


@query("rmwd", [])
def rmwd(spark, d):
    c = E.covariance(view(spark, d, "frames_v"))
    g = E.gaussian_w2(c.where("ensemble_id <> 0"), c.where("ensemble_id = 0")).groupBy("ensemble_id")
    t = g.agg(F.sqrt(F.avg(F.col("translation") ** 2)).alias("translation"), F.sqrt(F.avg(F.col("variance") ** 2)).alias("variance"))
    return rounded(t.withColumn("rmwd", F.hypot("translation", "variance")), "translation", "variance", "rmwd")


@query("pca", [])
def pca(spark, d):
    """Variances along the first three principal axes of each ensemble."""
    return rounded(E.principal_axes(view(spark, d, "frames_v")).select("ensemble_id", "axis", "variance"), "variance", digits=5)


@query("pc1_cosine", [])
def pc1_cosine(spark, d):
    """How well an ensemble's first axis agrees with the reference's."""
    a = E.principal_axes(view(spark, d, "frames_v"), 1)
    ref = a.where("ensemble_id = 0").select(F.col("direction").alias("r"))
    dot = F.aggregate(F.zip_with("direction", "r", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rounded(a.where("ensemble_id <> 0").crossJoin(F.broadcast(ref)).select("ensemble_id", F.abs(dot).alias("cosine")), "cosine", digits=5)  # one row


EXPOSED = "e as (select ensemble_id, frame_idx, res_idx, abs(x) > 2.5 as on_ from frames_v)"


@query("exposure_jaccard", ["frames_v"], EXPOSED + """,
    b as (select res_idx from e where ensemble_id = 0 and frame_idx = 0 and not on_), p as (select ensemble_id, res_idx, avg(case when on_ then 1.0 else 0.0 end) > 0.1 as open from e join b using (res_idx) group by ensemble_id, res_idx)
    select a.ensemble_id, round(sum(case when a.open and r.open then 1 else 0 end) / nullif(sum(case when a.open or r.open then 1 else 0 end), 0), 6) as jaccard from p a join p r on a.res_idx = r.res_idx and r.ensemble_id = 0 where a.ensemble_id <> 0 group by a.ensemble_id""")
def exposure_jaccard(spark, d):
    """Points buried in the reference structure that an ensemble and the reference ensemble expose in more than a tenth of their frames."""
    e = _exposed(spark, d)
    return rounded(E.exposure_jaccard(e.where("ensemble_id <> 0"), e.where("ensemble_id = 0"), e.where("ensemble_id = 0 and frame_idx = 0")), "jaccard")


def _exposed(spark, d):
    return view(spark, d, "frames_v").select("ensemble_id", "frame_idx", "res_idx", (F.abs("x") > 2.5).alias("on"))


@query("exposure_mi", ["frames_v"], EXPOSED + """,
    j as (select a.ensemble_id, a.res_idx as i, b.res_idx as j, avg(case when a.on_ then 1.0 else 0 end) as p, avg(case when b.on_ then 1.0 else 0 end) as q, avg(case when a.on_ and b.on_ then 1.0 else 0 end) as n11 from e a join e b on a.ensemble_id = b.ensemble_id and a.frame_idx = b.frame_idx and a.res_idx < b.res_idx group by 1, 2, 3),
    t as (select *, n11 as a, p - n11 as b, q - n11 as c, 1 - p - q + n11 as d from j)
    select ensemble_id, i, j, round(case when a > 1e-12 then a * ln(a / (p * q)) else 0 end + case when b > 1e-12 then b * ln(b / (p * (1 - q))) else 0 end + case when c > 1e-12 then c * ln(c / ((1 - p) * q)) else 0 end + case when d > 1e-12 then d * ln(d / ((1 - p) * (1 - q))) else 0 end, 6) + 0 as mi from t""")
def exposure_mi(spark, d):
    """Mutual information, in nats, of whether two points are exposed."""
    return rounded(E.exposure_mi(_exposed(spark, d)), "mi").withColumn("mi", F.col("mi") + 0.0)  # no negative zeros


@query("native_fraction", ["frames_v"], PAIRS + """,
    n as (select i, j, d as d0 from d where ensemble_id = 0 and frame_idx = 0 and j - i >= 3 and d < 8)
    select d.ensemble_id, d.frame_idx, round(avg(case when d.d <= 1.2 * d0 then 1.0 else 0.0 end), 6) as q from d join n using (i, j) group by d.ensemble_id, d.frame_idx""")
def native_fraction(spark, d):
    """Share of the reference structure's contacts that a frame has within 1.2 times their distance."""
    f = view(spark, d, "frames_v")
    native = E.pair_distances(f.where("ensemble_id = 0 and frame_idx = 0"), 3).where("d < 8").select("i", "j", F.col("d").alias("d0"))
    p = E.pair_distances(f, 3).join(native, ["i", "j"])
    return rounded(p.groupBy("ensemble_id", "frame_idx").agg(F.avg((F.col("d") <= 1.2 * F.col("d0")).cast("double")).alias("q")), "q")


@query("local_neighbours", ["frames_v"], PAIRS + ", " + NEAR + " select ensemble_id, i, j from k")
def local_neighbours(spark, d):
    """Points at least three apart along the chain whose median distance is within 30 (coordinates are stretched here)."""
    return E.local_neighbours(view(spark, d, "frames_v"), 30.0)


@query("gdt_drmsd", ["frames_v"], PAIRS + """,
    r as (select res_idx, x, y, z from frames_v where ensemble_id = 0 and frame_idx = 0),
    g as (select f.ensemble_id, f.frame_idx, sqrt((f.x - r.x) * (f.x - r.x) + (f.y - r.y) * (f.y - r.y) + (f.z - r.z) * (f.z - r.z)) as d from frames_v f join r using (res_idx)),
    s as (select ensemble_id, frame_idx, (avg(case when d <= 1 then 1.0 else 0 end) + avg(case when d <= 2 then 1.0 else 0 end) + avg(case when d <= 4 then 1.0 else 0 end) + avg(case when d <= 8 then 1.0 else 0 end)) / 4 as ts,
      (avg(case when d <= 0.5 then 1.0 else 0 end) + avg(case when d <= 1 then 1.0 else 0 end) + avg(case when d <= 2 then 1.0 else 0 end) + avg(case when d <= 4 then 1.0 else 0 end)) / 4 as ha from g group by ensemble_id, frame_idx),
    q as (select a.ensemble_id, a.frame_idx, sqrt(avg((a.d - b.d) * (a.d - b.d))) as drmsd from d a join d b on a.i = b.i and a.j = b.j and b.ensemble_id = 0 and b.frame_idx = 0 group by a.ensemble_id, a.frame_idx)
    select s.ensemble_id, s.frame_idx, round(ts, 6) as gdt_ts, round(ha, 6) as gdt_ha, round(drmsd, 6) as drmsd from s join q using (ensemble_id, frame_idx)""")
def gdt_drmsd(spark, d):
    """Shares of a frame's points near the reference structure's, and the root-mean-square difference of its inner distances."""
    f = view(spark, d, "frames_v")
    return rounded(E.gdt_drmsd(f, f.where("ensemble_id = 0 and frame_idx = 0")), "gdt_ts", "gdt_ha", "drmsd")


@query("extreme_gap_rate", ["frames_v"], PAIRS + " select ensemble_id, frame_idx, round(avg(case when sqrt(1e-6 + d * d) - 3.80209737096 > 1.5 then 1.0 else 0.0 end), 6) as rate from d where j = i + 1 group by ensemble_id, frame_idx")
def extreme_gap_rate(spark, d):
    """Share of a frame's neighbours that are more than 1.5 farther apart than they should be."""
    near = E.pair_distances(view(spark, d, "frames_v"), 1).where("j = i + 1")
    return rounded(near.groupBy("ensemble_id", "frame_idx").agg(F.avg((F.sqrt(1e-6 + F.col("d") ** 2) - 3.80209737096 > 1.5).cast("double")).alias("rate")), "rate")


@query("collapse_guard", ["frames_v"], RMSD + """,
    s as (select ensemble_id, avg(d) as spread from p group by ensemble_id), m as (select ensemble_id, avg(r) as rmsf from (select ensemble_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) as r from frames_v group by ensemble_id, res_idx) group by ensemble_id),
    g as (select s.ensemble_id, s.spread / nullif(r.spread, 0) as ratio, m.rmsf / nullif(k.rmsf, 0) as rmsf_ratio from s join m using (ensemble_id), s r, m k where r.ensemble_id = 0 and k.ensemble_id = 0)
    select ensemble_id, round(ratio, 6) as ratio, round(rmsf_ratio, 6) as rmsf_ratio, case when ratio is null or ratio not between 0.1 and 5.0 then 'void' when ratio not between 0.5 and 2.0 then 'flagged' else 'ok' end as verdict from g""")
def collapse_guard(spark, d):
    """Whether an ensemble is about as diverse as the reference: the ratios of mean distances and of fluctuations, and a verdict on the first."""
    f = view(spark, d, "frames_v")
    spread = E.frame_distances(E.flat(f).withColumn("label", F.lit("all"))).groupBy("ensemble_id").agg((F.sum("total") / F.sum("n")).alias("spread"))
    own = spread.join(E.rmsf(f).groupBy("ensemble_id").agg(F.avg("rmsf").alias("rmsf")), "ensemble_id")
    ref = own.where("ensemble_id = 0").select(F.col("spread").alias("s0"), F.col("rmsf").alias("r0"))
    g = own.crossJoin(F.broadcast(ref)).select("ensemble_id", (F.col("spread") / F.nullif(F.col("s0"), F.lit(0.0))).alias("ratio"), (F.col("rmsf") / F.nullif(F.col("r0"), F.lit(0.0))).alias("rmsf_ratio"))  # one row
    return rounded(g.withColumn("verdict", E.diversity(F.col("ratio"))), "ratio", "rmsf_ratio")


#: Draws where all resamples, or all signs, are too many.
DRAWS = 10_000


@query("bootstrap_ci", ["arms_v"], PAIRED + f""",
    o as (select metric, diff, row_number() over (partition by metric order by family) - 1 as i, count(*) over (partition by metric) as n from p where diff is not null),
    k as (select metric, unnest(range(0, cast(case when pow(any_value(n), any_value(n)) <= 200000 then pow(any_value(n), any_value(n)) else {DRAWS} end as bigint))) as k from o group by metric), c as (select distinct metric, n, i as pos from o),
    r as (select k, metric, case when pow(n, n) <= 200000 then cast(floor(k / pow(n, pos)) as bigint) % n else ('0x' || substr(sha256('15|' || metric || '|' || k || '|' || pos), 1, 12))::bigint % n end as i from c join k using (metric)), mm as (select r.metric, k, avg(diff) as mean from r join o on o.metric = r.metric and o.i = r.i group by r.metric, k)
    select metric, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, count(*) as resamples from mm group by metric""")
def bootstrap_ci(spark, d):
    """Percentile interval of the mean paired difference over resamples of the families."""
    return rounded(E.bootstrap(_paired(spark, d).where("diff is not null"), "metric", "family", "diff", DRAWS, 15), "low", "high")


@query("signflip_p", ["arms_v"], PAIRED + f""",
    o as (select metric, family, diff, row_number() over (partition by metric order by family) - 1 as i, count(*) over (partition by metric) as n, abs(avg(diff) over (partition by metric)) as seen from p where diff is not null), k as (select metric, unnest(range(0, case when any_value(n) <= 20 then cast(pow(2, any_value(n)) as bigint) else {DRAWS} end)) as k from o group by metric),
    mm as (select metric, k, any_value(seen) as seen, any_value(n) as n, abs(avg(case when case when n <= 20 then (k >> i) % 2 else ('0x' || substr(sha256('16|' || metric || '|' || k || '|' || family), 1, 12))::bigint % 2 end = 0 then diff else -diff end)) as mean from o join k using (metric) group by metric, k)
    select metric, round(avg(case when mean >= seen - 1e-12 then 1.0 else 0.0 end), 6) as p, 2.0 / pow(2, any_value(n)) as floor, count(*) as signs from mm group by metric""")
def signflip_p(spark, d):
    """Two-sided p of the mean paired difference under random signs, and the least p that so few families allow."""
    return rounded(E.sign_flips(_paired(spark, d).where("diff is not null"), "metric", "family", "diff", DRAWS, 16), "p")


_T = ", ".join(f"({n}, {power.t_critical(n - 1)!r}, {power.detectable(n)!r})" for n in range(2, 31))


@query("verdict", ["arms_v"], PAIRED + f""",
    q as (select * from (values {_T}) v(n, t, k)), l2 as (select family, metric, value from l where arm = 'R'),
    fl as (select metric, median(case when ends_with(metric, '_r') then case when abs(m) < 1 then sd / greatest(1e-12, 1 - m * m) end when m > 0 then sd / m end) as spread from (select family, metric, avg(value) as m, stddev_samp(value) as sd from l2 group by family, metric) group by metric),
    s as (select metric, count(diff) as n, avg(diff) as mean, stddev_samp(diff) as sd from p group by metric),
    x as (select s.*, mean - t * sd / sqrt(s.n) as low, mean + t * sd / sqrt(s.n) as high, k * sd as least, spread from s left join q on q.n = s.n left join fl using (metric))
    select metric, n, round(mean, 6) as mean, round(low, 5) as low, round(high, 5) as high, round(least, 5) as detectable,
      case when n < 2 or not (low > 0 or high < 0) or abs(mean) < least then 'cannot resolve' when abs(mean) < spread then 'supported but within the floor' else 'supported' end as verdict from x""")
def verdict(spark, d):
    """Whether the paired differences support a better arm: the t interval excludes 0 and the effect is detectable; within the floor if it is
    smaller than the reference's own spread."""
    from .ensembles import floor_spread

    s = _paired(spark, d).groupBy("metric").agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))
    s = s.join(floor_spread(spark, d), "metric", "left")
    s = s.join(_critical(spark, s), "n", "left")
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    s = s.select("metric", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), (F.col("k") * F.col("sd")).alias("detectable"), "spread")
    clear = ((F.col("low") > 0) | (F.col("high") < 0)) & (F.abs("mean") >= F.col("detectable"))
    word = F.when((F.col("n") < 2) | ~F.coalesce(clear, F.lit(False)), "cannot resolve").when(F.abs("mean") < F.col("spread"), "supported but within the floor").otherwise("supported")
    return rounded(rounded(s.select("metric", "n", "mean", "low", "high", "detectable", word.alias("verdict")), "mean"), "low", "high", "detectable", digits=5)


@query("paired_t", ["arms_v"], PAIRED + f""",
    q as (select * from (values {_T}) v(n, t, k)), s as (select metric, count(diff) as n, avg(diff) as mean, stddev_samp(diff) as sd, cast(greatest(sum(case when diff > 0 then 1 else 0 end), sum(case when diff < 0 then 1 else 0 end)) as bigint) as same_sign from p group by metric)
    select metric, s.n, round(mean, 6) as mean, round(sd, 6) as sd, same_sign, round(mean - t * sd / sqrt(s.n), 5) as low, round(mean + t * sd / sqrt(s.n), 5) as high, round(k * sd, 5) as detectable from s left join q on q.n = s.n""")
def paired_t(spark, d):
    """Paired differences of each metric: mean, deviation, how many have the same sign, t interval, detectable effect."""
    count = lambda c: F.sum(c.cast("long"))
    s = _paired(spark, d).groupBy("metric").agg(F.count("diff").alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.greatest(count(F.col("diff") > 0), count(F.col("diff") < 0)).alias("same_sign"))
    s = s.join(_critical(spark, s), "n", "left")
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    s = s.select("metric", "n", "mean", "sd", "same_sign", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), (F.col("k") * F.col("sd")).alias("detectable"))
    return rounded(rounded(s, "mean", "sd"), "low", "high", "detectable", digits=5)


def _critical(spark, stats):
    """(n, t, k): critical value and detectable effect for each number of pairs that occurs."""
    sizes = sorted({r.n for r in stats.select("n").distinct().collect() if r.n > 1})  # a number of families each
    return spark.createDataFrame([(n, power.t_critical(n - 1), power.detectable(n)) for n in sizes] or [(0, None, None)], "n long, t double, k double")
