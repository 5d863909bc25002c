"""Queries that write the given tables in a text format to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..operators import catalogs as C
from ..operators.selection import latest_per_key
from ..sources import text as T
from .catalogs import rounded
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


def _written(spark, lines, name):
    """Lines (value) written as text files and read back."""
    return spark.read.text(sinks.write_lines(lines, "value", sinks.own_folder(spark, name)))


def _catalog(spark, d):
    m = view(spark, d, "members_v")
    path = sinks.own_folder(spark, "catalog")
    text = lambda c: F.col(c).cast("string").alias(c)
    moving = F.col("is_trajectory")
    rows = m.select(text("family_id"), F.lit("AC").alias("seqres"), text("member_id"), F.when(~moving, F.col("path")).alias("pdb_path"), F.when(moving, F.col("path")).alias("xtc_path"), F.when(moving, F.concat("path", F.lit(".pdb"))).alias("xtc_top_pdb"), F.lit(None).cast("int").alias("frame_idx"), F.when(moving, F.col("n_frames")).alias("n_frames"))
    T.write_catalog(rows, path)
    return T.read_catalog(spark, path, lines=True)


@query("scan_catalog", ["members_v"], "select family_id, member_id, is_trajectory, path, case when is_trajectory then n_frames end as n_frames from members_v")
def scan_catalog(spark, d):
    """Members of catalog JSON."""
    c = _catalog(spark, d)
    return c.select(F.col("family_id").cast("long").alias("family_id"), F.col("member_id").cast("int").alias("member_id"), F.col("xtc_path").isNotNull().alias("is_trajectory"), F.coalesce("pdb_path", "xtc_path").alias("path"), "n_frames")


@query("write_catalog", ["members_v"], "select family_id, count(*) as members, count(case when is_trajectory then 1 end) as trajectories, cast(coalesce(sum(case when is_trajectory then n_frames end), 0) as bigint) as frames from members_v group by family_id")
def write_catalog(spark, d):
    """What a written catalog holds of each family."""
    return _catalog(spark, d).groupBy(F.col("family_id").cast("long").alias("family_id")).agg(F.count("*").alias("members"), F.count("xtc_path").alias("trajectories"), F.coalesce(F.sum("n_frames"), F.lit(0)).alias("frames"))


@query("write_split", ["families_v"], "select family_id, case doc_id % 10 when 0 then 'test' when 1 then 'val' else 'train' end as split, 'modulo' as policy from families_v")
def write_split(spark, d):
    path = sinks.own_folder(spark, "split")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    sinks.write_split(view(spark, d, "families_v").select("family_id", split.alias("split")), {"policy": "modulo", "seed": 0}, path)
    meta = spark.read.schema("policy string, seed string").json(f"{path}/meta")
    return spark.read.schema("family_id string, split string").parquet(f"{path}/assignment").crossJoin(F.broadcast(meta)).select("family_id", "split", "policy")  # one row


@query("write_selection", ["clusters_v"], "select token, max(seqlen) as seqlen, round(max(rmsd), 4) as rmsd from clusters_v where rmsd >= 2 group by token")
def write_selection(spark, d):
    path = sinks.own_folder(spark, "selection")
    c = view(spark, d, "clusters_v").where("rmsd >= 2").groupBy("token").agg(F.max("seqlen").alias("seqlen"), F.max("rmsd").alias("rmsd"))
    sinks.write_selection(rounded(c, "rmsd", digits=4), ["token", "seqlen", "rmsd"], path)
    return spark.read.option("header", True).schema("token string, seqlen long, rmsd double").csv(path)


@query("append_progress", ["clusters_v"], "select l_orderkey, line_no, status from clusters_v")
def append_progress(spark, d):
    """Progress lines written in two goes."""
    path = sinks.own_folder(spark, "progress")
    c = view(spark, d, "clusters_v").select("l_orderkey", "line_no", "status")
    for part in ("line_no % 2 = 0", "line_no % 2 = 1"):
        sinks.append_progress(c.where(part), path)
    return spark.read.schema("l_orderkey long, line_no int, status string").json(path)


@query("scan_manifest_jsonl", ["clusters_v"], "select l_orderkey, line_no, status from (select *, row_number() over (partition by l_orderkey order by line_no desc, status desc) as rn from clusters_v) where rn = 1")
def scan_manifest_jsonl(spark, d):
    """The last record of each key in JSON lines, among lines that are no JSON."""
    c = view(spark, d, "clusters_v")
    lines = c.select(F.to_json(F.struct("l_orderkey", "line_no", "status")).alias("value")).union(c.where("line_no = 1").select(F.lit("{broken").alias("value")))
    path = sinks.write_lines(lines, "value", sinks.own_folder(spark, "manifest"))
    return T.jsonl_latest(spark, path, "l_orderkey long, line_no int, status string", "l_orderkey", "line_no")


@query("scan_id_list", ["exposure_v"], "select distinct id from exposure_v where trim(id) <> ''")
def scan_id_list(spark, d):
    """Ids of a CSV whose id column isn't its first."""
    path = sinks.own_folder(spark, "ids")
    x = view(spark, d, "exposure_v").select(F.length("list_name").alias("seqlen"), F.lit("").alias("family_id"), F.col("id").alias("name"))
    sinks.write_selection(x, ["seqlen", "family_id", "name"], path)
    return T.id_list(spark.read.option("header", True).schema("seqlen string, family_id string, name string").csv(path))


@query("scan_entity_clusters", ["clusters_v"], "m as (select l_orderkey, min(token) as cluster_id from clusters_v group by l_orderkey) select m.cluster_id, token from clusters_v join m using (l_orderkey)")
def scan_entity_clusters(spark, d):
    """Tokens of clusters, one cluster a line, some lines empty."""
    c = view(spark, d, "clusters_v").groupBy("l_orderkey").agg(F.concat_ws("  ", F.collect_list("token")).alias("value"))  # a line: at most seven tokens here
    lines = _written(spark, c.select("value").union(c.where("l_orderkey % 5 = 0").select(F.lit(" ").alias("value"))), "clusters")
    return T.cluster_lines(lines.withColumnRenamed("value", "line"))


def _pdb(spark, d):
    """Frames as structure files, a model each, one file an ensemble: (file, line_no, line)."""
    f = view(spark, d, "frames_v")
    atoms = f.select(F.col("ensemble_id").alias("family_id"), F.col("frame_idx").alias("member_id"), (F.col("res_idx") + 1).alias("resseq"), F.lit("CA").alias("atom"), F.lit("ALA").alias("resname"), "x", "y", "z", F.col("res_idx").cast("double").alias("bfactor"))
    lines = T.pdb_lines(atoms).select("family_id", "member_id", F.col("resseq").alias("at"), "line")
    marks = f.select(F.col("ensemble_id").alias("family_id"), F.col("frame_idx").alias("member_id")).distinct()
    head = marks.select("family_id", "member_id", F.lit(0).alias("at"), F.format_string("MODEL     %4d", F.col("member_id") % 10000).alias("line"))
    whole = lines.unionByName(head).select("family_id", "member_id", "at", F.to_json(F.struct(F.col("family_id").alias("file"), (F.col("member_id") * 1000 + F.col("at")).alias("line_no"), "line")).alias("value"))
    path = sinks.write_lines(whole, "value", sinks.own_folder(spark, "pdb"), ["family_id", "member_id", "at"])
    return spark.read.schema("file long, line_no long, line string").json(path)


@query("scan_pdb_atoms", ["frames_v"], "select ensemble_id as file, frame_idx + 1 as model, res_idx + 1 as resseq, 'CA' as atom, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z, cast(res_idx as double) as bfactor from frames_v")
def scan_pdb_atoms(spark, d):
    """Atoms of structure lines, with the model that they are in."""
    a = T.pdb_atoms(_pdb(spark, d))
    return a.select("file", "model", "resseq", "atom", "x", "y", "z", "bfactor")


@query("scan_multimodel_pdb", ["frames_v"], "select ensemble_id as file, frame_idx + 1 as model, count(*) as residues, 'A' as chain from frames_v group by ensemble_id, frame_idx")
def scan_multimodel_pdb(spark, d):
    """Models of structure lines with their residues, of the chain that comes first."""
    a = T.pdb_atoms(_pdb(spark, d))
    first = a.groupBy("file").agg(F.min(F.struct("line_no", "chain")).alias("f")).select("file", "f.chain")
    return a.join(first, ["file", "chain"]).groupBy("file", "model", "chain").agg(F.count_distinct("resseq").alias("residues"))


@query("write_pdb_text", ["frames_v"], "select ensemble_id as file, count(*) as lines, 80 as width from frames_v group by ensemble_id")
def write_pdb_text(spark, d):
    """Structure lines as written: how many a file, and how wide."""
    p = _pdb(spark, d).where("startswith(line, 'ATOM')")
    return p.groupBy("file").agg(F.count("*").alias("lines"), F.max(F.length("line")).alias("width"))


@query("rewrite_score_column", ["frames_v"], "select ensemble_id as file, frame_idx + 1 as model, res_idx + 1 as resseq, case when res_idx % 2 = 0 then round(res_idx * 1.5 + ensemble_id, 2) else cast(res_idx as double) end as score from frames_v")
def rewrite_score_column(spark, d):
    """A score for every other residue in the lines' score column; the others keep theirs."""
    lines = _pdb(spark, d).withColumn("resseq", F.when(F.col("line").startswith("ATOM"), F.substring("line", 23, 4).try_cast("int")))
    scores = lines.where("resseq % 2 = 1").select("file", "line_no", ((F.col("resseq") - 1) * 1.5 + F.col("file")).alias("score"))
    return T.pdb_atoms(T.with_scores(lines.select("file", "line_no", "line"), scores, ["file", "line_no"])).select("file", "model", "resseq", F.col("bfactor").alias("score"))


@query("scan_repr_meta", ["families_v"], "select seqres, family_id as index from families_v where doc_id % 4 in (0, 1) and seqres <> ''")
def scan_repr_meta(spark, d):
    """Metadata of artifacts: some lines are cut off, some have no sequence."""
    f = view(spark, d, "families_v")
    whole = F.to_json(F.struct("seqres", F.col("family_id").alias("index")))
    value = F.when(F.col("doc_id") % 4 == 2, F.substring(whole, 1, 12)).when(F.col("doc_id") % 4 == 3, F.to_json(F.struct(F.col("family_id").alias("index")))).otherwise(whole)
    return T.artifact_meta(_written(spark, f.select(value.alias("value")), "meta"))


@query("scan_gen_cases", ["families_v"], """
    select lang as dataset, family_id as case_id, case when doc_id % 3 = 0 then 'iid' else 'forward' end as task, cast(case when doc_id % 2 = 0 then doc_id % 7 + 1 else 8 end as int) as n_frames, 256 as stride, cast(unnest(range(0, case when doc_id % 5 = 0 then 3 else 2 end)) as int) as rep from families_v""")
def scan_gen_cases(spark, d):
    """Cases of generation manifests, one dataset a line, with what they take from it."""
    f = view(spark, d, "families_v")
    doc = F.col("doc_id")
    case = F.struct(F.col("family_id").alias("case_id"), F.when(doc % 3 == 0, "iid").alias("task"), F.when(doc % 2 == 0, doc % 7 + 1).alias("n_frames"), F.lit(None).cast("int").alias("stride"), F.when(doc % 5 == 0, 3).alias("n_replicates"))
    # A manifest line for each thousand of a language's cases: no line grows with the data.
    sets = f.groupBy("lang", F.floor(doc / 1000).alias("part")).agg(F.collect_list(case).alias("cases"))
    lines = sets.select(F.to_json(F.struct(F.col("lang").alias("dataset"), F.lit("forward").alias("task"), F.lit(8).alias("n_frames"), F.lit(256).alias("stride"), F.lit(2).alias("n_replicates"), "cases")).alias("value"))
    return T.generation_cases(_written(spark, lines, "cases")).select("dataset", "case_id", "task", "n_frames", "stride", "rep")


@query("scan_declared_seq", ["families_v"], """
    b as (select family_id, doc_id, regexp_replace(seqres, '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') as s from families_v), c as (select family_id, doc_id % 6 as k, s from b where s <> '')
    select family_id, case when k in (0, 1, 2) then s end as seqres, case k when 3 then 'records' when 4 then 'disagree' when 5 then 'alphabet' end as problem from c""")
def scan_declared_seq(spark, d):
    """Declared sequence files, two a family, as JSON lines of a name and a text."""
    f = view(spark, d, "families_v").select("family_id", (F.col("doc_id") % 6).alias("k"), F.regexp_replace("seqres", "[^ACDEFGHIKLMNPQRSTVWYX]", "").alias("s")).where("s <> ''")
    one = F.concat(F.lit(">a\n"), F.when(F.col("k") == 5, F.concat("s", F.lit("*"))).otherwise(F.col("s")), F.lit("\n"))
    two = F.when(F.col("k") == 3, F.concat(one, F.lit(">b\nAC\n"))).when(F.col("k") == 4, F.concat(one, F.lit("A\n"))).otherwise(F.lower(one))
    lines = f.select("family_id", F.explode(F.array(one, two)).alias("text")).select(F.to_json(F.struct("family_id", "text")).alias("value"))
    files = spark.read.schema("family_id string, text string").json(sinks.write_lines(lines, "value", sinks.own_folder(spark, "declared")))
    return T.declared_sequences(files, "family_id", "text")


@query("scan_obsolete_ids", [], "select lpad(cast(p_partkey % 10000 as varchar), 4, '0') as old, lpad(cast(p_size as varchar), 4, 'x') as new from part where p_partkey % 3 <> 0")
def scan_obsolete_ids(spark, d):
    """Replaced ids of fixed-width lines, some without a replacement."""
    p = spark.read.parquet(f"{d}/part.parquet")
    old, new = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.upper(F.lpad(F.col("p_size").cast("string"), 4, "x"))
    line = F.concat(F.lit("OBSLTE    31-JUL-94 "), old, F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("     "), new)).otherwise(""))
    return T.obsolete_ids(_written(spark, p.select(line.alias("value")), "obsolete"))


@query("scan_hit_table", [], "select concat('T', p_partkey) as target, p_size / 1000.0 as e_value from part")
def scan_hit_table(spark, d):
    """Targets and e-values of a search table with comments."""
    p = spark.read.parquet(f"{d}/part.parquet")
    line = F.concat(F.lit("T"), F.col("p_partkey").cast("string"), F.lit("   -  query -   "), (F.col("p_size") / 1000.0).cast("string"), F.lit("  12.0 0.1"))
    lines = p.select(line.alias("value")).union(p.where("p_partkey % 50 = 0").select(F.lit("# comment   a b c d").alias("value")))
    return T.hit_table(_written(spark, lines, "hits"))


@query("scan_length_from_lines", ["log_v"], "select run, count(*) - 1 as n from log_v where line is not null and (run <> 'run3' or event_type = 'view') group by run")
def scan_length_from_lines(spark, d):
    """Lines of each run's first file; a run has an `a` and a `b` file, run3 only a `b` one."""
    g = view(spark, d, "log_v").where("line is not null")
    kind = F.when(F.col("run") == "run3", F.when(F.col("event_type") == "view", "b")).otherwise("a")
    rows = g.select("run", kind.alias("kind"), "line").where("kind is not null").union(g.where("run <> 'run3' and line_no % 7 = 0").select("run", F.lit("b").alias("kind"), "line"))
    rows = rows.union(g.where("line_no % 11 = 0").select("run", F.lit("a").alias("kind"), F.lit("  ").alias("line")).where("run <> 'run3'"))
    path = sinks.own_folder(spark, "lengths")
    rows.select("run", "kind", F.col("line").alias("value")).write.partitionBy("run", "kind").text(path)
    return T.line_lengths(spark.read.schema("value string, run string, kind string").text(path), "run", "kind", ["a", "b"])


@query("run_manifest", ["families_v"], "select case doc_id % 10 when 0 then 'test' when 1 then 'val' else 'train' end as split, count(*) as n, 'done' as status from families_v group by 1")
def run_manifest(spark, d):
    """A run's record, appended when it starts and when it ends; the latest counts, with its families by split."""
    path = sinks.own_folder(spark, "runs")
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").otherwise("train")
    counts = view(spark, d, "families_v").groupBy(split.alias("split")).agg(F.count("*").alias("n"))
    record = counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "n")))).alias("counts"))  # three splits
    for seq, status in enumerate(("started", "done")):
        sinks.append_progress(record.select(F.lit("run").alias("run"), F.lit(seq).alias("seq"), F.lit(status).alias("status"), "counts"), path)
    last = latest_per_key(spark.read.schema("run string, seq int, status string, counts string").json(path), ["run"], ["seq"])
    return last.select(F.explode(F.from_json("counts", "map<string, bigint>")).alias("split", "n"), "status")


@query("write_heldout_manifest", ["members_v"], "select family_id, count(*) as cases, min(member_id) as first from members_v where family_id % 10 = 0 group by family_id")
def write_heldout_manifest(spark, d):
    """Cases held out, a family's a line of JSON below a line that describes them."""
    m = view(spark, d, "members_v").where("family_id % 10 = 0")
    lines = m.groupBy("family_id").agg(F.sort_array(F.collect_list("member_id")).alias("cases")).select(F.to_json(F.struct("family_id", "cases")).alias("value"))
    head = spark.range(1).select(F.lit('{"split": "test", "seed": 0}').alias("value"))
    path = sinks.write_lines(lines.union(head), "value", sinks.own_folder(spark, "heldout"))
    own = spark.read.schema("family_id long, cases array<int>, split string").json(path).where("split is null")
    return own.select("family_id", F.size("cases").cast("long").alias("cases"), F.get("cases", F.lit(0)).alias("first"))


@query("scan_stockholm", ["msa_v"], """
    t as (select chain, row_idx, regexp_replace(seq, '\\s', '-', 'g') as seq from msa_v where chain is not null and seq <> ''), c as (select chain, row_idx, unnest(string_split(seq, '')) as letter, unnest(range(0, length(seq))) as col from t),
    f as (select chain, min(row_idx) as first from t group by chain), q as (select c.chain, col, letter from c join f on c.chain = f.chain and row_idx = first),
    x as (select c.*, coalesce(q.letter, '') <> '-' as keep from c left join q on q.chain = c.chain and q.col = c.col)
    select chain, row_idx, count(case when keep then 1 end) as places, md5(coalesce(string_agg(case when keep then letter end, '' order by col), '')) as digest, count(case when not keep and letter <> '-' and col < lastk then 1 end) as deletions
    from (select *, max(case when keep then col end) over (partition by chain, row_idx) as lastk from x) group by chain, row_idx""")
def scan_stockholm(spark, d):
    """Alignments in blocks of sixty letters, read back without the places where their first row has a gap."""
    m = view(spark, d, "msa_v").where("chain is not null and seq <> ''").select("chain", "row_idx", F.regexp_replace("seq", r"\s", "-").alias("seq"))
    block = F.explode(F.expr("transform(sequence(0, (length(seq) - 1) div 60), i -> named_struct('at', i, 'part', substring(seq, 60 * i + 1, 60)))"))
    lines = m.select("chain", "row_idx", block.alias("b")).select("chain", (F.col("b.at") * 1_000_000_000 + F.col("row_idx")).alias("line_no"), F.concat(F.lit("r"), F.col("row_idx").cast("string"), F.lit(" "), F.col("b.part")).alias("line"))
    path = sinks.write_lines(lines.select(F.to_json(F.struct("chain", "line_no", "line")).alias("value")), "value", sinks.own_folder(spark, "stockholm"))
    rows = T.stockholm_rows(spark.read.schema("chain string, line_no long, line string").json(path), ["chain"])
    own = T.without_query_gaps(rows, ["chain"])
    total = F.aggregate("deletions", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return own.select("chain", F.substring("name", 2, 12).cast("int").alias("row_idx"), F.length("aligned").cast("long").alias("places"), F.md5("aligned").alias("digest"), total.alias("deletions"))


def _digests(spark, d):
    from .streams import logs

    f = T.file_digests(spark, logs(spark, d), "*.txt")
    return f.select(F.regexp_extract("path", r"run=([^/]+)/", 1).alias("name"), "size", "digest")


DIGESTS = "g as (select run as name, string_agg(line || chr(10), '' order by line_no) as content from log_v where line is not null group by run), s as (select name, cast(strlen(content) as bigint) as size, sha256(content) as digest from g)"


@query("scan_file_digests", ["log_v"], DIGESTS + " select name, size, digest from s")
def scan_file_digests(spark, d):
    """Size and digest of each run's log file."""
    return _digests(spark, d)


@query("verify_payload", ["log_v"], DIGESTS + " select name, case name when 'run0' then 'corrupt' else 'not listed' end as problem from s where name in ('run0', 'run1') union all select 'run9', 'missing'")
def verify_payload(spark, d):
    """Log files against a list that has a wrong digest for one, lacks one and names one that isn't there."""
    found = _digests(spark, d)
    wrong = F.when(F.col("name") == "run0", F.reverse("digest")).otherwise(F.col("digest"))
    lines = found.where("name <> 'run1'").select(F.concat(wrong, F.lit("  "), "name").alias("value")).union(spark.range(1).select(F.lit("00  run9").alias("value")))
    return C.verify(T.digest_manifest(_written(spark, lines, "digests")), found)
