"""Queries over file listings, structure files, domains, id lists, and exact enumerations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles as E
from ..operators import stores as D
from .catalogs import rounded
from .records import PAIRED, _paired
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


#: A store's files: each order is a folder, its lines are files of several kinds and places.
_FILES = """select concat(cast(l_orderkey as {s}), '/', case when l_orderkey % 11 = 3 then 'analysis/' when l_orderkey % 7 < 3 then 'protein/' when l_linenumber % 5 = 4 then 'protein/old/' else '' end,
      case when l_orderkey % 7 < 3 and l_linenumber > 1 and l_orderkey % 13 <> 1 then concat(cast(l_orderkey as {s}), '_R', cast(l_linenumber % 3 as {s}), case when l_quantity > 25 then '_fit' else '' end, case when l_orderkey % 11 = 3 and l_linenumber = 2 then '.pdb' else '.xtc' end)
        when l_linenumber % 4 = 3 then 'notes.txt' when l_linenumber = 1 then concat(cast(l_orderkey as {s}), case when l_orderkey % 17 = 2 then '.cif' else '.pdb' end) else concat('m', cast(l_linenumber as {s}), '.pdb') end) as path from lineitem"""


@query("scan_family_dirs", [], f"""
    with f as (select distinct path from ({_FILES.format(s='varchar')})), p as (select path, string_split(path, '/') as p from f),
    o as (select path, p[1] as family_id, p[-1] as name, case len(p) when 2 then '' when 3 then p[2] end as folder, regexp_replace(p[-1], '\\.[^.]*$', '') as stem, case when ends_with(path, '.xtc') then 'xtc' when ends_with(path, '.pdb') then 'pdb' end as kind from p),
    w as (select * from o where kind is not null),
    s as (select family_id, bool_or(kind = 'xtc') as moves, bool_or(kind = 'pdb' and coalesce(folder, '-') = '') as top, bool_or(kind = 'pdb' and coalesce(folder, '-') in ('protein', 'analysis')) as below,
      min(case when kind = 'pdb' and folder = 'protein' then concat(case when stem = family_id then '0' else '1' end, path) end) as topology, bool_or(kind = 'xtc' and coalesce(folder, '-') = 'protein') as replicas from w group by family_id),
    l as (select family_id, case when moves or (not top and below) then 'trajectory' when top then 'static' end as layout, substr(topology, 2) as topology, case when topology is null then 'no protein structure' when not replicas then 'no replica trajectories' end as error from s),
    r as (select w.family_id, layout, case when regexp_extract(stem, '_R([0-9]+)(?:_fit)?$', 1) <> '' then 'R' || regexp_extract(stem, '_R([0-9]+)(?:_fit)?$', 1) else stem end as member_id, path, topology, ends_with(name, '_fit.xtc') as fit, name from w join l using (family_id) where layout = 'trajectory' and error is null and kind = 'xtc' and folder = 'protein')
    select w.family_id, layout, stem as member_id, path, null as topology, null as error from w join l using (family_id) where layout = 'static' and kind = 'pdb' and folder = ''
    union all select family_id, layout, member_id, path, topology, null from (select *, row_number() over (partition by family_id, member_id order by fit desc, name) as rn from r) where rn = 1
    union all select family_id, layout, 'ref', topology, null, null from l where layout = 'trajectory' and error is null
    union all select family_id, layout, null, null, null, error from l where layout = 'trajectory' and error is not null""")
def scan_family_dirs(spark, d):
    """Families of a store, by the paths of its files."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    files = spark.sql(_FILES.format(s="string").replace("from lineitem", "from {lineitem}"), lineitem=lines)
    return D.family_dirs(files)


#: Structure lines of each ensemble's frames with faults: hetero lines, insertion codes, other chains, gaps, by ensemble.
_ATOM = """select ensemble_id * 100 + frame_idx % 100 as file, res_idx as line_no, case when ensemble_id = 1 and res_idx > 15 then 2 else 0 end as model, ensemble_id = 2 and (res_idx = 20 or frame_idx % 3 = 0) as hetero,
      case when ensemble_id = 3 and res_idx % 2 = 1 then 'B' when ensemble_id = 3 then 'A' else '' end as altloc, case when ensemble_id = 4 and res_idx > 9 then 'B' else 'A' end as chain,
      case when ensemble_id = 5 and res_idx > 5 then res_idx + 2 when ensemble_id = 6 and res_idx = 20 then 1 when ensemble_id = 3 then cast(floor(res_idx / 2) as int) + 1 else res_idx + 1 end as resseq, case when ensemble_id = 7 and res_idx = 4 then 'A' else '' end as icode,
      case res_idx % 4 when 0 then 'CA' when 1 then '1HB' when 2 then 'HG' else 'CB' end as atom, case when ensemble_id % 2 = 0 then case when res_idx % 4 in (1, 2) then ' H' else ' C' end else '' end as element from frames_v"""


def _atoms(spark, d):
    return spark.sql(_ATOM.replace("from frames_v", "from {frames_v}"), frames_v=view(spark, d, "frames_v"))


@query("indexable_check", ["frames_v"], f"""
    a as ({_ATOM}), n as (select *, case when lag(model) over w is distinct from model or lag(hetero) over w is distinct from hetero or lag(chain) over w is distinct from chain or lag(resseq) over w is distinct from resseq or lag(icode) over w is distinct from icode then 1 else 0 end as new from a window w as (partition by file order by line_no)),
    b as (select *, sum(new) over (partition by file order by line_no) as block from n), k as (select file, block, any_value(model) as model, any_value(hetero) as hetero, any_value(chain) as chain, any_value(resseq) as resseq, any_value(icode) as icode, count(distinct nullif(altloc, '')) as alts from b group by file, block),
    p as (select *, sum(case when hetero then 0 else 1 end) over (partition by file order by block) as place from k),
    f as (select file, count(distinct model) as models, count(case when not hetero then 1 end) as residues, count(distinct case when not hetero then chain end) as chains, count(case when hetero then 1 end) as hets, count(case when not hetero and icode <> '' then 1 end) as icodes, count(case when not hetero and alts > 1 then 1 end) as alts,
      count(distinct case when not hetero then resseq end) as numbers, count(case when not hetero and resseq <> place then 1 end) as off from p group by file)
    select file, case when models > 1 then 'models' when residues = 0 then 'no polymer' when chains > 1 then 'chains' when hets > 0 then 'hetero' when icodes > 0 then 'insertion codes' when alts > 0 then 'alternate locations' when numbers < residues then 'repeated number' when off > 0 then 'numbering' end as violation from f""")
def indexable_check(spark, d):
    """Whether each structure file's residues may be placed by their numbers, or why not."""
    return D.indexable_check(_atoms(spark, d))


@query("atom_select", ["frames_v"], f"""
    a as (select *, coalesce(nullif(upper(trim(element)), ''), upper(substr(regexp_replace(atom, '^[0-9]+', ''), 1, 1))) = 'H' as h from ({_ATOM}))
    select file, count(case when atom = 'CA' then 1 end) as ca, count(case when not h then 1 end) as heavy, count(*) as "all" from a group by file""")
def atom_select(spark, d):
    """How many atoms of a file each selection takes."""
    a = _atoms(spark, d)
    counts = [D.atom_select(a, s).groupBy("file").agg(F.count("*").alias(s)) for s in ("all", "heavy", "ca")]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts[0].join(counts[1], "file", "left").join(counts[2], "file", "left").select("file", zero("ca"), zero("heavy"), "all")


@query("flexibility_report", [])
def flexibility_report(spark, d):
    """Two domains of eight points and the five between, in every ensemble."""
    rows = E.flat(view(spark, d, "frames_v"))
    return rounded(D.flexibility_report(rows, list(range(8)), list(range(13, 21)), list(range(8, 13))), "value", digits=5)


def _by_region(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("family"), "n_regionkey")
    return _paired(spark, d).where("diff is not null").join(nation, "family").select(F.concat_ws("/", "metric", F.col("n_regionkey").cast("string")).alias("metric"), "family", "diff")


_REGION = ", o as (select p.metric || '/' || n_regionkey as metric, family, diff from p join nation on n_name = family where diff is not null), u as (select metric, family, diff, row_number() over (partition by metric order by family) - 1 as i, count(*) over (partition by metric) as n from o)"


@query("bootstrap_exact", ["arms_v"], PAIRED + _REGION + """,
    k as (select metric, any_value(n) as n, unnest(range(0, cast(pow(any_value(n), any_value(n)) as bigint))) as k from u group by metric),
    r as (select k.metric, k, avg(x.diff) as mean from k join u s on s.metric = k.metric join u x on x.metric = k.metric and x.i = cast(floor(k / pow(k.n, s.i)) as bigint) % k.n group by k.metric, k)
    select metric, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high, count(*) as resamples from r group by metric""")
def bootstrap_exact(spark, d):
    """The interval over all ordered resamples, where a metric's families, those of a region, are few."""
    return rounded(E.bootstrap(_by_region(spark, d), "metric", "family", "diff", 10_000, 15), "low", "high")


@query("signflip_exact", ["arms_v"], PAIRED + _REGION + """,
    k as (select metric, any_value(n) as n, abs(avg(diff)) as seen, unnest(range(0, cast(pow(2, any_value(n)) as bigint))) as k from u group by metric),
    mm as (select k.metric, k, any_value(k.n) as n, any_value(seen) as seen, abs(avg(case when (k >> i) % 2 = 0 then diff else -diff end)) as mean from k join u on u.metric = k.metric group by k.metric, k)
    select metric, round(avg(case when mean >= seen - 1e-12 then 1.0 else 0.0 end), 6) as p, 2.0 / pow(2, any_value(n)) as floor, count(*) as signs from mm group by metric""")
def signflip_exact(spark, d):
    """The exact two-sided p over all signs of a region's families."""
    return rounded(E.sign_flips(_by_region(spark, d), "metric", "family", "diff", 10_000, 16), "p")


@query("approx_distinct_within", ["families_v"], "select source, count(distinct seqres) as exact, true as within from families_v group by source")
def approx_distinct_within(spark, d):
    """Whether the sketch of distinct texts (three standard errors of 2 %) agrees with the exact number."""
    g = view(spark, d, "families_v").groupBy("source").agg(F.countDistinct("seqres").alias("exact"), F.approx_count_distinct("seqres", 0.02).alias("about"))
    return g.select("source", "exact", (F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(2.0), 0.06 * F.col("exact"))).alias("within"))


@query("novelty_lists", ["exposure_v", "families_v"], """
    f as (select family_id, cast(doc_id as varchar) as a, lpad(cast(doc_id as varchar), 4, '0') as b from families_v), h as (select f.family_id, list_name from f join exposure_v on id = a or id = b group by f.family_id, list_name),
    n as (select list_name, count(*) as dropped from h group by list_name), l as (select distinct list_name from exposure_v)
    select l.list_name, coalesce(dropped, 0) as dropped, (select count(*) from f where family_id not in (select family_id from h)) as novel from l left join n using (list_name)""")
def novelty_lists(spark, d):
    """Of all families, how many each exposure list drops, and how many are on none of the three."""
    f = view(spark, d, "families_v").select("family_id", F.explode(F.array_distinct(F.array(F.col("doc_id").cast("string"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))).alias("id"))
    lists = view(spark, d, "exposure_v")
    hit = f.join(lists, "id").select("family_id", "list_name").distinct()
    counts = lists.select("list_name").distinct().join(hit.groupBy("list_name").agg(F.count("*").alias("dropped")), "list_name", "left")
    novel = f.select("family_id").distinct().join(hit.select("family_id").distinct(), "family_id", "left_anti").agg(F.count("*").alias("novel"))
    return counts.crossJoin(F.broadcast(novel)).select("list_name", F.coalesce("dropped", F.lit(0)).alias("dropped"), "novel")  # one row


@query("list_filters", ["families_v", "exposure_v"], """
    x as (select distinct lower(trim(id)) as id from exposure_v where list_name = 'labels'), w as (select distinct cast(doc_id as varchar) as id from families_v where length(seqres) % 3 <> 0),
    f as (select distinct cast(doc_id as varchar) || '_' || lang as family_id, cast(doc_id as varchar) as e from families_v), a as (select * from f where lower(family_id) not in (select id from x) and lower(e) not in (select id from x)), b as (select * from a where e in (select id from w))
    select 'exclude' as step, (select count(*) from f) as before, (select count(*) from f) - (select count(*) from a) as matched, (select count(*) from a) as kept, null as warning
    union all select 'allow', (select count(*) from a), (select count(*) from b), (select count(*) from b), case when 2 * ((select count(*) from a) - (select count(*) from b)) >= (select count(*) from a) then 'drops half or more' end""")
def list_filters(spark, d):
    """The report of an exclude list and an allow list over all families."""
    f = view(spark, d, "families_v")
    families = f.select(F.concat_ws("_", F.col("doc_id").cast("string"), "lang").alias("family_id"))
    allowed = f.where(F.length("seqres") % 3 != 0).select(F.col("doc_id").cast("string").alias("id"))
    return D.id_filters(families, view(spark, d, "exposure_v").where("list_name = 'labels'"), allowed)[1]


@query("merge_catalogs_whole", ["members_v"], """
    a as (select family_id, member_id, path, 'left' as side from members_v where family_id % 3 <> 0), b as (select family_id, member_id, path, 'right' as side from members_v where family_id % 5 <> 0),
    u as (select family_id, member_id, min(path) as path, count(distinct side) as sides, min(side) as side from (select * from a union all select * from b) group by family_id, member_id)
    select family_id, count(*) as members, case when max(sides) = 2 then 'both' else min(side) end as side, (family_id % 3 <> 0 and family_id % 5 <> 0) as collision from u group by family_id
    union all select distinct family_id, 0, 'missing', false from members_v where family_id % 15 = 0""")
def merge_catalogs_whole(spark, d):
    """Two catalogs as one: a family's members once, the side they come from, collisions, and wanted families that neither has."""
    m = view(spark, d, "members_v").select("family_id", "member_id", "path")
    both = m.where("family_id % 3 <> 0").withColumn("side", F.lit("left")).union(m.where("family_id % 5 <> 0").withColumn("side", F.lit("right")))
    one = both.groupBy("family_id", "member_id").agg(F.min("path").alias("path"), F.count_distinct("side").alias("sides"), F.min("side").alias("side"))
    out = one.groupBy("family_id").agg(F.count("*").alias("members"), F.when(F.max("sides") == 2, "both").otherwise(F.min("side")).alias("side"), (F.max("sides") == 2).alias("collision"))
    missing = m.select("family_id").distinct().join(out.select("family_id"), "family_id", "left_anti")
    return out.unionByName(missing.select("family_id", F.lit(0).cast("long").alias("members"), F.lit("missing").alias("side"), F.lit(False).alias("collision")))


@query("rolling_mean_adaptive", ["trajectory_v"], """
    v as (select replica, frame_idx, case when segment <> 'view' then value end as value, count(*) over (partition by replica) as n from trajectory_v), w as (select *, least(200, greatest(10, n // 40)) as k from v)
    select replica, frame_idx, cast(k as int) as "window", round(avg(value) over (partition by replica order by frame_idx rows between (k - 1) preceding and current row), 5) as mean from w""")
def rolling_mean_adaptive(spark, d):
    """Rolling mean of a replica's values but for those of one segment, over a window that grows with the replica."""
    from ..operators.windows import adaptive_mean

    rows = view(spark, d, "trajectory_v").withColumn("value", F.when(F.col("segment") != "view", F.col("value")))
    return rounded(adaptive_mean(rows, "replica", "frame_idx", "value"), "mean", digits=5)


@query("scan_id_lines", ["exposure_v"], "select distinct split_part(id, ' ', 1) as id from exposure_v where trim(id) <> ''")
def scan_id_lines(spark, d):
    """Ids of a plain list: a line each, some with remarks, some that are nothing but a remark."""
    from .. import sinks
    from ..sources import text as T

    x = view(spark, d, "exposure_v")
    lines = x.select(F.concat(F.lit("  "), "id", F.when(F.col("list_name") == "labels", " # toxic").otherwise("")).alias("value")).union(x.where("list_name = 'suppliers'").select(F.concat(F.lit("# "), "id").alias("value")))
    return T.id_lines(spark.read.text(sinks.write_lines(lines, "value", sinks.own_folder(spark, "lines"))))


@query("gen_case_faults", ["clusters_v"], """
    c as (select cluster_id as dataset, case when l_orderkey % 97 = 0 then null else cast(l_orderkey as varchar) end as case_id, line_no % 3 as rep from clusters_v), w as (select distinct cast(l_orderkey + 1 as varchar) as case_id from clusters_v where l_orderkey % 50 = 0)
    select dataset, case_id, rep, case when case_id is null then 'no id' else 'repeated' end as fault from c group by dataset, case_id, rep having count(*) > 1 or case_id is null union all select null, case_id, null, 'unknown' from w where case_id not in (select case_id from c where case_id is not null)""")
def gen_case_faults(spark, d):
    """Cases of a manifest that repeat or have no id, and wanted ones that it lacks."""
    from ..sources import text as T

    c = view(spark, d, "clusters_v")
    cases = c.select(F.col("cluster_id").alias("dataset"), F.when(F.col("l_orderkey") % 97 != 0, F.col("l_orderkey").cast("string")).alias("case_id"), (F.col("line_no") % 3).alias("rep"))
    return T.case_faults(cases, c.where("l_orderkey % 50 = 0").select((F.col("l_orderkey") + 1).cast("string").alias("case_id")))
