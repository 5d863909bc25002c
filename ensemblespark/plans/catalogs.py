"""Queries over catalogs, clusters, lists and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import identity as I
from ..operators import selection as S
from .views import oracle, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(views or [], sql) if views else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


ENTRY = "split_part(token, '_', 1)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "clusters_v")
    return c.withColumns({"predicted": F.col("token").startswith("AF_"), "entry": F.split_part("token", F.lit("_"), F.lit(1))})


@query("parquet_tables", sql="select count(*) as n, count(distinct l_orderkey) as orders, round(sum(l_quantity), 2) as quantity from lineitem")
def parquet_tables(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("pick_replica_file", ["members_v"], """
    p as (select family_id, member_id % 3 as replica, concat(path, '_R', cast(member_id % 3 as varchar), case when n_frames % 2 = 0 then '_fit' else '' end) as file, n_frames % 2 = 0 as is_fit from members_v)
    select family_id, replica, file from (select *, row_number() over (partition by family_id, replica order by is_fit desc, file) as rn from p) where rn = 1""")
def pick_replica_file(spark, d):
    m = view(spark, d, "members_v")
    files = m.select("family_id", F.concat("path", F.lit("_R"), (F.col("member_id") % 3).cast("string"), F.when(F.col("n_frames") % 2 == 0, "_fit").otherwise("")).alias("file"))
    own = files.select("family_id", F.regexp_extract("file", r"_R(\d+)(_fit)?$", 1).cast("int").alias("replica"), "file", F.when(F.col("file").endswith("_fit"), 0).otherwise(1).alias("plain"))
    return own.groupBy("family_id", "replica").agg(F.min(F.struct("plain", "file")).alias("b")).select("family_id", "replica", "b.file")


@query("entry_id", ["families_v"], """
    f as (select family_id, concat(substr(family_id, 5, 4), '_', lang) as name from families_v)
    select family_id, case when regexp_matches(split_part(name, '_', 1), '^[0-9][0-9A-Za-z]{3}$') and regexp_matches(split_part(name, '_', 2), '^[0-9A-Za-z]{1,4}$') then split_part(name, '_', 1) end as entry from f""")
def entry_id(spark, d):
    f = view(spark, d, "families_v")
    return f.select("family_id", X.entry_id(F.concat(F.substring("family_id", 5, 4), F.lit("_"), F.col("lang"))).alias("entry"))


@query("parse_member_token", ["clusters_v"], """
    select token, count(*) as n, case when starts_with(token, 'AF_') then 'predicted' when regexp_matches(token, '^[0-9][0-9A-Za-z]{3}_[0-9]+$') then 'pdb' else 'other' end as kind,
      split_part(token, '_', 1) as entry, try_cast(regexp_extract(token, '_([0-9]+)$', 1) as bigint) as entity from clusters_v group by token""")
def parse_member_token(spark, d):
    c = view(spark, d, "clusters_v").groupBy("token").agg(F.count("*").alias("n"))
    kind = F.when(F.col("token").startswith("AF_"), "predicted").when(F.col("token").rlike("^[0-9][0-9A-Za-z]{3}_[0-9]+$"), "pdb").otherwise("other")
    return c.select("token", "n", kind.alias("kind"), F.split_part("token", F.lit("_"), F.lit(1)).alias("entry"), F.regexp_extract("token", "_([0-9]+)$", 1).try_cast("bigint").alias("entity"))


@query("hash_unit", sql="""
    select c_custkey, round(cast(('0x' || substr(sha256('7' || chr(0) || c_name), 1, 12))::bigint as double) / 281474976710656.0, 6) as u from customer""")
def hash_unit(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", F.round(X.unit_hash(F.lit(7), F.col("c_name")), 6).alias("u"))


@query("component_rank", sql="select c_name, sha256('11:' || c_name) as h from customer")
def component_rank(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_name", X.rank_hash(F.lit(11), F.col("c_name")).alias("h"))


@query("natural_key", sql="select p_partkey, coalesce(try_cast(regexp_extract(p_name, '([0-9]+)[^0-9]*$', 1) as bigint), -1) as k from part")
def natural_key(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.natural_key(F.col("p_name")).alias("k"))


@query("kmers", sql="""
    with s as (select p_partkey, upper(trim(p_name)) as s from part)
    select p_partkey, cast(case when length(s) <= 8 then 1 else len(list_distinct(list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8)))) end as bigint) as n from s""")
def kmers(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.size(X.kmers(F.col("p_name"))).cast("long").alias("n"))


@query("encode_sequence", ["families_v"], """
    select family_id, cast(sum(instr('ACDEFGHIKLMNPQRSTVWY', c) - 1) as bigint) as total, cast(sum(case when instr('ACDEFGHIKLMNPQRSTVWY', c) = 0 then 1 else 0 end) as bigint) as unknown
    from (select family_id, unnest(string_split(seqres, '')) as c from families_v) group by family_id""")
def encode_sequence(spark, d):
    """Sum of the letters' places in the alphabet, -1 for one that isn't in it, and how many aren't; an empty sequence has neither."""
    letters = view(spark, d, "families_v").select("family_id", F.explode(F.split("seqres", "")).alias("c"))
    code = F.instr(F.lit("ACDEFGHIKLMNPQRSTVWY"), F.col("c"))
    return letters.groupBy("family_id").agg(F.sum(code - 1).alias("total"), F.sum((code == 0).cast("long")).alias("unknown"))


@query("rebase_path", ["members_v"], """
    select family_id, member_id, case when starts_with(path, '/store0/') then concat('/new/a', substr(path, 8)) when starts_with(path, '/store1/') then concat('/new/b', substr(path, 8)) end as path,
      not (starts_with(path, '/store0/') or starts_with(path, '/store1/')) as outside from members_v""")
def rebase_path(spark, d):
    roots = {"/store0/": "/new/a/", "/store1/": "/new/b/"}
    new = F.lit(None).cast("string")
    for old, to in reversed(roots.items()):
        new = F.when(F.col("path").startswith(old), F.concat(F.lit(to), F.expr(f"substring(path, {len(old) + 1})"))).otherwise(new)
    return view(spark, d, "members_v").select("family_id", "member_id", new.alias("path"), new.isNull().alias("outside"))


@query("threshold_select", ["clusters_v"], """
    select cluster_id, token, max(rmsd) as rmsd from clusters_v where seqlen <= 300 and rmsd >= 1.9 and coalesce(identity, 0) >= 0.2 group by cluster_id, token""")
def threshold_select(spark, d):
    c = view(spark, d, "clusters_v").where((F.col("seqlen") <= 300) & (F.col("rmsd") >= 1.9) & (F.coalesce("identity", F.lit(0)) >= 0.2))
    return c.groupBy("cluster_id", "token").agg(F.max("rmsd").alias("rmsd"))


@query("filter_trail", ["clusters_v"], """
    f as (select case when not seqlen <= 300 then 0 when not rmsd >= 1.9 then 1 when not coalesce(identity, 0) >= 0.2 then 2 else 3 end as step from clusters_v),
    c as (select l.step, l.label, count(f.step) as removed from (values (0, 'length'), (1, 'rmsd'), (2, 'identity'), (3, '')) l(step, label) left join f on f.step = l.step group by l.step, l.label)
    select step, label, removed, remaining from (select *, cast(coalesce(sum(removed) over (order by step rows between 1 following and unbounded following), 0) as bigint) as remaining from c) where step < 3""")
def filter_trail(spark, d):
    rules = [("length", F.col("seqlen") <= 300), ("rmsd", F.col("rmsd") >= 1.9), ("identity", F.coalesce("identity", F.lit(0)) >= 0.2)]
    return S.filter_trail(view(spark, d, "clusters_v"), rules)


@query("member_bounds", ["clusters_v"], f"""
    select cluster_id, count(distinct {ENTRY}) as n from clusters_v where not starts_with(token, 'AF_') group by cluster_id having count(distinct {ENTRY}) between 5 and 100000""")
def member_bounds(spark, d):
    c = tokens(spark, d).where(~F.col("predicted"))
    return c.groupBy("cluster_id").agg(F.countDistinct("entry").alias("n")).where("n between 5 and 100000")


@query("latest_per_key", ["clusters_v"], """
    select cluster_id, l_orderkey, line_no, status from (select *, row_number() over (partition by cluster_id, l_orderkey order by line_no desc, status desc) as rn from clusters_v) where rn = 1""")
def latest_per_key(spark, d):
    return S.latest_per_key(view(spark, d, "clusters_v").select("cluster_id", "l_orderkey", "line_no", "status"), ["cluster_id", "l_orderkey"], ["line_no", "status"])


@query("band_select", ["clusters_v"], """
    l as (select concat(cluster_id, '/', cast(l_orderkey as varchar)) as unit, l_orderkey, line_no, status, rmsd, row_number() over (partition by cluster_id, l_orderkey order by line_no desc, status desc, rmsd desc) as rn from clusters_v)
    select unit, line_no, status, rmsd from l where rn = 1 and status <> 'ok' and rmsd >= 1.9 and rmsd < 3.0 and l_orderkey % 10 <> 0""")
def band_select(spark, d):
    c = view(spark, d, "clusters_v").withColumn("unit", F.concat_ws("/", "cluster_id", F.col("l_orderkey").cast("string")))
    blocked = c.where("l_orderkey % 10 = 0").select("unit").distinct()
    return S.band_select(c.select("unit", "line_no", "status", "rmsd"), blocked, 1.9, 3.0)


@query("novelty_entry_anti", ["clusters_v", "exposure_v"], f"""
    select distinct l_orderkey from clusters_v where l_orderkey not in (select l_orderkey from clusters_v join exposure_v on {ENTRY} = id and list_name = 'suppliers')""")
def novelty_entry_anti(spark, d):
    e = view(spark, d, "exposure_v").where("list_name = 'suppliers'")
    return S.not_exposed(tokens(spark, d).select("l_orderkey", "entry"), e, "l_orderkey", "entry")


@query("cluster_summary", ["clusters_v", "exposure_v"], f"""
    t as (select *, {ENTRY} as entry, starts_with(token, 'AF_') as predicted from clusters_v), e as (select distinct id from exposure_v)
    select cluster_id, cast(sum(case when not predicted then 1 else 0 end) as bigint) as n_entities, count(distinct case when not predicted then entry end) as n_pdb, count(*) as n_raw,
      cast(sum(case when predicted then 1 else 0 end) as bigint) as n_predicted, bool_or(id is not null and not predicted) as overlaps, min(case when not predicted then token end) as representative
    from t left join e on entry = id group by cluster_id""")
def cluster_summary(spark, d):
    return S.cluster_summary(tokens(spark, d), view(spark, d, "exposure_v"))


@query("union_exposure", ["exposure_v"], "select distinct id from exposure_v")
def union_exposure(spark, d):
    return view(spark, d, "exposure_v").select("id").distinct()


@query("novelty_anti", ["exposure_v"], "select s_name from supplier where lpad(cast(s_suppkey as varchar), 4, '0') not in (select id from exposure_v where list_name = 'suppliers')")
def novelty_anti(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("id", F.lpad(F.col("s_suppkey").cast("string"), 4, "0"))
    return s.join(view(spark, d, "exposure_v").where("list_name = 'suppliers'").select("id"), "id", "left_anti").select("s_name")


@query("allow_exclude", ["families_v", "exposure_v"], """
    select family_id from families_v where lower(cast(doc_id as varchar) || '_' || lang) not in (select id from exposure_v where list_name = 'labels') and lower(cast(doc_id as varchar)) not in (select id from exposure_v where list_name = 'labels')""")
def allow_exclude(spark, d):
    f = view(spark, d, "families_v").select("family_id", F.concat_ws("_", F.col("doc_id").cast("string"), "lang").alias("name"))
    return S.allow_exclude(f, view(spark, d, "exposure_v").where("list_name = 'labels'"), "name", False).select("family_id")


@query("length_cap", ["families_v"], "select family_id, length(seqres) as n from families_v where length(seqres) <= 2000")
def length_cap(spark, d):
    return view(spark, d, "families_v").select("family_id", F.length("seqres").cast("long").alias("n")).where("n <= 2000")


@query("chain_filters", ["families_v"], """
    c as (select family_id, c, count(*) as n from (select family_id, unnest(string_split(replace(seqres, ' ', ''), '')) as c from families_v) where c <> '' group by family_id, c)
    select family_id, cast(sum(n) as bigint) as letters, round(max(n) / sum(n), 6) as top from c group by family_id having max(n) / sum(n) <= 0.8 and sum(n) >= 200""")
def chain_filters(spark, d):
    f = view(spark, d, "families_v").select("family_id", F.explode(F.split(F.replace("seqres", F.lit(" "), F.lit("")), "")).alias("c")).where("c <> ''")
    c = f.groupBy("family_id", "c").agg(F.count("*").alias("n")).groupBy("family_id").agg(F.sum("n").alias("letters"), (F.max("n") / F.sum("n")).alias("top"))
    return rounded(c.where("top <= 0.8 and letters >= 200"), "top")


@query("edges_equal", ["families_v"], "select a, family_id as b from (select family_id, min(family_id) over (partition by seqres) as a from families_v) where a <> family_id")
def edges_equal(spark, d):
    return I.star_edges(view(spark, d, "families_v"), F.sha2("seqres", 256), "family_id")


@query("edges_shared_key", ["members_v"], """
    m as (select distinct family_id, path from members_v), a as (select path, min(family_id) as a from m group by path)
    select distinct a, family_id as b from m join a using (path) where a <> family_id""")
def edges_shared_key(spark, d):
    return I.star_edges(view(spark, d, "members_v"), F.col("path"), "family_id")


@query("homology_pairs", sql="""
    with p as (select p_partkey as id, upper(trim(p_name)) as s from part), t as (
      select id, s, list_distinct(case when length(s) <= 8 then [s] else list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8)) end) as k from p
    ), u as (select id, unnest(k) as k from t), n as (select count(*) as n from t),
    g as (select k from u group by k having count(*) >= 2 and count(*) <= (select case when n <= 500 then n else greatest(50, cast(floor(n * 0.25) as bigint)) end from n)),
    c as (select distinct x.id as a, y.id as b from u x join u y on x.k = y.k and x.id < y.id join g on g.k = x.k),
    r as (select a, b, len(list_intersect(x.k, y.k)) as shared, len(list_intersect(x.k, y.k)) / least(len(x.k), len(y.k)) as containment,
      case when length(x.s) <= length(y.s) then length(x.s) >= 20 and contains(y.s, x.s) else length(y.s) >= 20 and contains(x.s, y.s) end as substring
      from c join t x on x.id = a join t y on y.id = b)
    select a, b, shared, round(containment, 6) as containment, substring from r where substring or containment >= 0.5""")
def homology_pairs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.upper(F.trim("p_name")).alias("s"))
    return I.homology_pairs(p, "p_partkey", "s", digits=6)


def _all_edges(spark, d) -> DataFrame:
    """Edges of families that share any path, whether of a static or a trajectory member."""
    return I.star_edges(view(spark, d, "members_v"), F.col("path"), "family_id")


@query("components")
def components(spark, d):
    """Components of families over all shared paths. No SQL: a recursion over all edges doesn't end."""
    return I.rooted(view(spark, d, "members_v").select(F.col("family_id").alias("node")), _all_edges(spark, d))


@query("component_report")
def component_report(spark, d):
    nodes = view(spark, d, "members_v").select(F.col("family_id").alias("node")).distinct()
    return I.component_report(I.rooted(nodes, _all_edges(spark, d)), nodes.withColumn("source", F.col("node") % 3))


@query("text_components")
def text_components(spark, d):
    """Components of document families by equal texts."""
    f = view(spark, d, "families_v")
    return I.rooted(f.select(F.col("family_id").alias("node")), I.star_edges(f, F.sha2("seqres", 256), "family_id"))


@query("fraction_split", ["families_v"], """
    h as (select family_id, ('0x' || substr(sha256('3' || chr(0) || family_id), 1, 12))::bigint / 281474976710656.0 as u from families_v)
    select family_id, case when u < 0.1 then 'test' when u < 0.2 then 'val' else 'train' end as split from h""")
def fraction_split(spark, d):
    f = view(spark, d, "families_v").select("family_id")
    return I.fraction_split(f, X.unit_hash(F.lit(3), F.col("family_id")), 0.1, 0.1)


@query("leakage_check", ["families_v"], """
    s as (select family_id, seqres, ('0x' || substr(sha256('3' || chr(0) || family_id), 1, 12))::bigint / 281474976710656.0 as u from families_v),
    l as (select family_id, seqres, case when u < 0.1 then 'test' when u < 0.2 then 'val' else 'train' end as split from s), a as (select seqres, min(family_id) as a from l group by seqres)
    select a, l.family_id as b, x.split as split_a, l.split as split_b from l join a using (seqres) join l x on x.family_id = a where a <> l.family_id and x.split <> l.split""")
def leakage_check(spark, d):
    f = view(spark, d, "families_v")
    split = I.fraction_split(f.select(F.col("family_id").alias("node")), X.unit_hash(F.lit(3), F.col("node")), 0.1, 0.1)
    return I.leaks(I.star_edges(f, F.sha2("seqres", 256), "family_id"), split)


@query("id_set_diff", sql="""
    select doc_id as id, 'left' as side from documents where doc_id not in (select doc_id from labels) union all select distinct doc_id, 'right' from labels where doc_id not in (select doc_id from documents)""")
def id_set_diff(spark, d):
    return I.id_differences(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query("seeded_shuffle", ["families_v"], """
    h as (select family_id, sha256('5' || chr(0) || family_id) as h from families_v) select family_id, cast(row_number() over (order by substr(h, 1, 12), family_id) as bigint) as place from h""")
def seeded_shuffle(spark, d):
    f = view(spark, d, "families_v").select("family_id", F.substring(F.sha2(F.concat_ws("\x00", F.lit("5"), "family_id"), 256), 1, 12).alias("h"))
    return S.ranked(f, [], ["h", "family_id"], "place").select("family_id", "place")


@query("split_select", ["families_v"], "select lang, count(*) as n, median(length(seqres)) as middle from families_v where source = 'src1' group by lang")
def split_select(spark, d):
    f = view(spark, d, "families_v")
    chosen = f.select("source").distinct().where("source = 'src1'")
    return f.join(chosen, "source", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.median(F.length("seqres")).alias("middle"))


@query("merge_catalogs", ["members_v"], """
    a as (select distinct family_id from members_v where is_trajectory), b as (select distinct family_id from members_v where not is_trajectory)
    select family_id, family_id in (select family_id from a) as left_side, family_id in (select family_id from b) as right_side, family_id in (select family_id from a) and family_id in (select family_id from b) as collision from (select family_id from a union select family_id from b)""")
def merge_catalogs(spark, d):
    m = view(spark, d, "members_v")
    both = m.groupBy("family_id").agg(F.max("is_trajectory").alias("left_side"), F.max(~F.col("is_trajectory")).alias("right_side"))
    return both.withColumn("collision", F.col("left_side") & F.col("right_side"))


@query("merge_index", ["members_v"], """
    l as (select path, 0 as layer, min(family_id) as v from members_v group by path union all select path, 1, min(family_id) from members_v where is_trajectory group by path union all select path, 2, max(member_id) from members_v where n_frames > 4000 group by path)
    select path, v from (select *, row_number() over (partition by path order by layer desc) as rn from l) where rn = 1 and path not in (select path from members_v where n_frames < 150)""")
def merge_index(spark, d):
    m = view(spark, d, "members_v")
    layers = [m.groupBy("path").agg(F.min("family_id").alias("v")), m.where("is_trajectory").groupBy("path").agg(F.min("family_id").alias("v")), m.where("n_frames > 4000").groupBy("path").agg(F.max("member_id").cast("long").alias("v"))]
    return S.upsert(layers, "path", m.where("n_frames < 150").select("path").distinct())


@query("merge_same_seq", ["families_v", "members_v"], """
    s as (select family_id, count(distinct path) as n from (select family_id as f, path from members_v) m join families_v on doc_id = f group by family_id),
    o as (select f.*, coalesce(s.n, 0) as n from families_v f left join s using (family_id)),
    k as (select seqres, family_id as keeper from (select *, row_number() over (partition by seqres order by n desc, doc_id) as rn from o) where rn = 1),
    p as (select seqres, count(distinct path) as n_paths from families_v join (select family_id as f, path from members_v) m on doc_id = f group by seqres)
    select keeper, coalesce(n_paths, 0) as n_paths from k left join p using (seqres)""")
def merge_same_seq(spark, d):
    f = view(spark, d, "families_v")
    m = view(spark, d, "members_v").select(F.col("family_id").alias("doc_id"), "path").join(f.select("doc_id", "family_id"), "doc_id").drop("doc_id")
    return S.merge_same_sequence(f, m)


@query("iid_cap", ["members_v"], """
    s as (select family_id, count(*) as n from members_v group by family_id), c as (select unnest(range(1, (select max(n) from s) + 1)) as cap),
    t as (select cap, sum(least(n, cap)) as draws, max(least(n, cap)) as top from c cross join s group by cap), b as (select coalesce(min(cap), 1000000000) as b from t where cap > draws * 0.08)
    select max(cap) as cap, cast(arg_max(draws, cap) as bigint) as draws from t, b where cap < b""")
def iid_cap(spark, d):
    return S.share_cap(view(spark, d, "members_v").groupBy("family_id").agg(F.count("*").alias("size")), "size", 0.08)


@query("bag_sizes", ["members_v"], "select family_id, cast(sum(n_frames) as bigint) as frames, min(n_frames) as low, median(n_frames) as middle, max(n_frames) as high from members_v group by family_id")
def bag_sizes(spark, d):
    return view(spark, d, "members_v").groupBy("family_id").agg(F.sum("n_frames").alias("frames"), F.min("n_frames").alias("low"), F.median("n_frames").alias("middle"), F.max("n_frames").alias("high"))


@query("grouping_rollup", ["families_v"], "select source, lang, count(*) as n, cast(grouping(source) + grouping(lang) as bigint) as level from families_v group by rollup (source, lang)")
def grouping_rollup(spark, d):
    return view(spark, d, "families_v").rollup("source", "lang").agg(F.count("*").alias("n"), (F.grouping("source") + F.grouping("lang")).cast("long").alias("level"))


@query("shard_assign", ["clusters_v"], "select cluster_id, cast((row_number() over (order by cluster_id) - 1) % 4 as bigint) as shard from (select distinct cluster_id from clusters_v)")
def shard_assign(spark, d):
    c = view(spark, d, "clusters_v").select("cluster_id").distinct()
    return S.ranked(c, [], ["cluster_id"], "place").select("cluster_id", ((F.col("place") - 1) % 4).cast("long").alias("shard"))


@query("top_filtered_sorted", ["clusters_v"], "select distinct token from clusters_v where not starts_with(token, 'AF_') order by token limit 20")
def top_filtered_sorted(spark, d):
    return tokens(spark, d).where(~F.col("predicted")).select("token").distinct().orderBy("token").limit(20)


@query("approx_distinct", ["families_v"], "select source, count(distinct seqres) as exact from families_v group by source")
def approx_distinct(spark, d):
    return view(spark, d, "families_v").groupBy("source").agg(F.countDistinct("seqres").alias("exact"))


@query("settled_filter", ["clusters_v"], """
    u as (select cluster_id, l_orderkey, arg_max(status, line_no * 10 + case status when 'rejected' then 2 when 'ok' then 1 else 0 end) as status, max(rmsd) as peak, count(*) as n from clusters_v group by cluster_id, l_orderkey)
    select cluster_id, l_orderkey, status, peak from u where status in ('ok', 'rejected') and not (n > 2 or peak > 1.99)""")
def settled_filter(spark, d):
    c = view(spark, d, "clusters_v").withColumn("o", F.col("line_no") * 10 + F.when(F.col("status") == "rejected", 2).when(F.col("status") == "ok", 1).otherwise(0))
    u = c.groupBy("cluster_id", "l_orderkey").agg(F.max(F.struct("o", "status")).alias("s"), F.max("rmsd").alias("peak"), F.count("*").alias("n"))
    return u.select("cluster_id", "l_orderkey", "s.status", "peak", "n").where("status in ('ok', 'rejected') and not (n > 2 or peak > 1.99)").drop("n")


@query("family_admission", ["clusters_v"], """
    select cluster_id, l_orderkey, count(*) as n, case when count(*) < 2 then 'too few' when max(rmsd) < 1.85 then 'too alike' when max(rmsd) > 1.99 then 'too far' else 'ok' end as verdict from clusters_v group by cluster_id, l_orderkey""")
def family_admission(spark, d):
    g = view(spark, d, "clusters_v").groupBy("cluster_id", "l_orderkey").agg(F.count("*").alias("n"), F.max("rmsd").alias("r"))
    return g.select("cluster_id", "l_orderkey", "n", F.when(F.col("n") < 2, "too few").when(F.col("r") < 1.85, "too alike").when(F.col("r") > 1.99, "too far").otherwise("ok").alias("verdict"))


@query("keep_probability", ["families_v"], """
    c as (select family_id, source, length(seqres) as n, count(*) over (partition by source) as size from families_v)
    select family_id, round(least(greatest(n, 256), 512) / 512.0 / size, 9) as p, ('0x' || substr(sha256('9' || chr(0) || family_id), 1, 12))::bigint / 281474976710656.0 < least(greatest(n, 256), 512) / 512.0 / size as kept from c""")
def keep_probability(spark, d):
    f = view(spark, d, "families_v")
    sized = f.join(f.groupBy("source").agg(F.count("*").alias("size")), "source")
    p = F.least(F.greatest(F.length("seqres"), F.lit(256)), F.lit(512)) / 512.0 / F.col("size")
    return sized.select("family_id", F.round(p, 9).alias("p"), (X.unit_hash(F.lit(9), F.col("family_id")) < p).alias("kept"))
