"""Text formats as DataFrames. Each reader takes lines or whole texts and stays within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER = T.StructType([T.StructField(n, t) for n, t in (("member_id", T.StringType()), ("pdb_path", T.StringType()), ("xtc_path", T.StringType()), ("xtc_top_pdb", T.StringType()), ("frame_idx", T.IntegerType()), ("n_frames", T.IntegerType()))])
CATALOG = T.StructType([T.StructField("families", T.ArrayType(T.StructType([T.StructField("family_id", T.StringType()), T.StructField("seqres", T.StringType()), T.StructField("members", T.ArrayType(MEMBER))])))])


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(family_id, seqres, member fields): nested catalog JSON, one document a file, or with lines=True one a
    line; relative paths are joined to the file's folder."""
    raw = spark.read.schema(CATALOG).json(path, multiLine=not lines).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("at"), F.explode("families").alias("f"))
    m = raw.select("at", "f.family_id", "f.seqres", F.explode_outer("f.members").alias("m"))
    whole = lambda c: F.when(F.col(f"m.{c}").startswith("/"), F.col(f"m.{c}")).when(F.col(f"m.{c}").isNotNull(), F.concat_ws("/", "at", f"m.{c}")).alias(c)
    return m.select("family_id", "seqres", "m.member_id", whole("pdb_path"), whole("xtc_path"), whole("xtc_top_pdb"), "m.frame_idx", "m.n_frames")


def nest_catalog(rows: DataFrame) -> DataFrame:
    """Member rows back to one family per row, members in order of their ids."""
    fields = F.struct("member_id", "pdb_path", "xtc_path", "xtc_top_pdb", "frame_idx", "n_frames")
    return rows.groupBy("family_id", "seqres").agg(F.sort_array(F.collect_list(fields)).alias("members"))


def fasta_records(texts: DataFrame, column: str) -> DataFrame:
    """texts' other columns with (place, header, sequence); `#` and blank lines are skipped, wrapped lines joined."""
    rest = [c for c in texts.columns if c != column]
    clean = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace(F.col(column), "\r", ""), "(?m)^#.*$", ""))
    parts = texts.select(*rest, F.posexplode(F.split(clean, "\n>")).alias("place", "part")).where("place > 0")
    return parts.select(*rest, "place", F.split_part("part", F.lit("\n"), F.lit(1)).alias("header"), F.regexp_replace(F.regexp_replace("part", "^[^\n]*", ""), r"\s", "").alias("sequence"))


def a3m_rows(records: DataFrame) -> DataFrame:
    """FASTA records with `aligned` (lower-case insertions removed) and `deletions` before each column."""
    marks = F.split(F.regexp_replace("sequence", "[^a-z]", "|"), r"\|")
    counts = F.transform(marks, lambda x: F.length(x))
    return records.withColumns({"aligned": F.regexp_replace("sequence", "[a-z]", ""), "deletions": F.slice(counts, 1, F.size(counts) - 1)})


def stockholm_rows(lines: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, name, first, sequence) from (group, line_no, line): interleaved blocks joined by name, first being a
    name's first line; markup and blank lines skipped."""
    group = group or []
    own = lines.where(~F.col("line").rlike(r"^(#|//|\s*$)"))
    parts = own.select(*group, "line_no", F.regexp_extract("line", r"^(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract("line", r"^(\S+)\s+(\S+)", 2).alias("part"))
    g = parts.groupBy(*group, "name").agg(F.min("line_no").alias("first"), F.sort_array(F.collect_list(F.struct("line_no", "part"))).alias("p"))
    return g.select(*group, "name", "first", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("sequence"))


def without_query_gaps(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Stockholm rows with `aligned`, their letters at the places where the alignment's first row has one, and
    `deletions`, the letters left out before each of these."""
    group = group or []
    query = rows.groupBy(*group).agg(F.min(F.struct("first", F.col("sequence").alias("q"))).alias("_f")).select(*group, F.col("_f.q").alias("_q"))
    own = rows.join(query, group) if group else rows.crossJoin(F.broadcast(query))  # one row
    # One pass over both rows' letters; a letter left out becomes a mark, a kept one a bar, so counts are lengths between bars.
    both = F.zip_with(F.split("sequence", ""), F.split("_q", ""), lambda c, q: F.struct(c.alias("c"), (F.coalesce(q, F.lit("")) != "-").alias("keep")))
    own = own.withColumn("_l", F.filter(both, lambda x: x["c"] != ""))
    aligned = F.array_join(F.transform(F.filter("_l", lambda x: x["keep"]), lambda x: x["c"]), "")
    marks = F.split(F.array_join(F.transform("_l", lambda x: F.when(x["keep"], "|").when(x["c"] != "-", "x").otherwise("")), ""), r"\|")
    counts = F.transform(F.slice(marks, 1, F.size(marks) - 1), lambda x: F.length(x))
    return own.select(*rows.columns, aligned.alias("aligned"), counts.alias("deletions"))


def store_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder, relative to it; their content is never read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/")
    return listed.select(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "").alias("path")).select(F.substr("path", F.lit(len(whole) + 2)).alias("path"))


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """(file, model, atom fields) from (file, line_no, line): fixed columns of ATOM and HETATM
    lines; the model is the number of MODEL lines so far, 0 without any."""
    by = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("model", F.sum(F.col("line").startswith("MODEL").cast("int")).over(by))
    cut = lambda a, n: F.trim(F.substring("line", a, n))
    number = lambda a, n, t: cut(a, n).try_cast(t)
    return own.where(F.col("line").rlike("^(ATOM  |HETATM)")).select(
        "file", "line_no", "model", F.col("line").startswith("HETATM").alias("hetero"), number(7, 5, "int").alias("serial"), cut(13, 4).alias("atom"), cut(17, 1).alias("altloc"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"),
        number(23, 4, "int").alias("resseq"), cut(27, 1).alias("icode"), number(31, 8, "double").alias("x"), number(39, 8, "double").alias("y"), number(47, 8, "double").alias("z"), number(61, 6, "double").alias("bfactor"), cut(77, 2).alias("element"),
    )


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """(family_id, member_id, resseq, line): atoms as 80-column lines; a null coordinate is left out."""
    number = F.row_number().over(Window.partitionBy("family_id", "member_id").orderBy("resseq", "atom"))
    own = atoms.where("x is not null and y is not null and z is not null").withColumn("serial", number)
    line = F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s  ", "serial", F.concat(F.lit(" "), F.rpad("atom", 3, " ")), "resname", F.lit("A"), "resseq", "x", "y", "z", F.lit(1.0), F.coalesce("bfactor", F.lit(0.0)), F.substring("atom", 1, 1))
    return own.select("family_id", "member_id", "resseq", line.alias("line"))


def cluster_lines(lines: DataFrame) -> DataFrame:
    """(cluster_id, token) from lines of whitespace-separated tokens; a cluster is named by its least token."""
    own = lines.select(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "").alias("t")).where(F.size("t") > 0)
    return own.select(F.array_min("t").alias("cluster_id"), F.explode("t").alias("token"))


#: The columns an id is looked for in, in this order.
ID_COLUMNS = ("chain_id", "family_id", "name", "index", "pdb_id")


def id_list(rows: DataFrame, columns: tuple[str, ...] = ID_COLUMNS) -> DataFrame:
    """Distinct ids of a table: the first non-empty of its id columns, else its first column; `#` lines skipped."""
    known = [c for c in columns if c in rows.columns] or rows.columns[:1]
    first = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in known])
    return rows.select(first.alias("id")).where("id is not null and not startswith(id, '#')").distinct()


def id_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct ids of a plain list: the first word of each line, what follows a `#` left out. A list without ids is an error."""
    own = lines.select(F.split_part(F.trim(F.regexp_replace(F.split_part(column, F.lit("#"), F.lit(1)), r"[\s,]+", " ")), F.lit(" "), F.lit(1)).alias("id")).where("id <> ''").distinct()
    if not own.take(1):
        raise ValueError("the list of ids is empty")
    return own


def case_faults(cases: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(dataset, case_id, rep, fault): cases (dataset, case_id, rep) that stand in a manifest more than once, or without an id;
    and, given a subset (case_id) to be made, ids of it that no manifest has."""
    counts = cases.groupBy("dataset", "case_id", "rep").agg(F.count("*").alias("n"))
    out = counts.where("n > 1 or case_id is null").select("dataset", "case_id", "rep", F.when(F.col("case_id").isNull(), "no id").otherwise("repeated").alias("fault"))
    if wanted is None:
        return out
    missing = wanted.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti")
    return out.unionByName(missing.select(F.lit(None).cast("string").alias("dataset"), "case_id", F.lit(None).cast("int").alias("rep"), F.lit("unknown").alias("fault")))


def run_log(lines: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """(run, order, kind, step, samples, loss, value fields) of heartbeat and validation lines; a
    carriage return separates lines; old and new spellings of a field are both read."""
    split = lines.select(run, order, F.posexplode(F.split(F.col(line), "[\r\n]+")).alias("part", "l"))

    def field(pattern: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract("l", pattern, 1), F.lit("")).try_cast(kind)

    kind = F.when(F.col("l").startswith("[val]"), "val").when(F.col("l").startswith("[step "), "train")
    return split.select(
        run, order, "part", kind.alias("kind"), F.coalesce(field(r"^\[step (\d+)\]", "long"), field(r"\bstep=(\d+)", "long")).alias("step"), field(r"\bepoch=(\d+)", "long").alias("epoch"), field(r"\bsamples=(\d+)", "long").alias("samples"),
        F.coalesce(field(r"train_loss\(mean over \d+\)=([-+.0-9eE]+)", "double"), field(r"\btrain_loss=([-+.0-9eE]+)", "double"), field(r"\bval_loss=([-+.0-9eE]+)", "double")).alias("loss"),
    ).where("kind is not null")


#: Fixed value: the shape of a checkpoint's file name.
CHECKPOINT = r"^([A-Za-z0-9]+)-(?:epoch([0-9]+)-(?:step([0-9]+)|(end))|(bestfwd|stopped)-step([0-9]+))\.ckpt$"


def checkpoint_name(name: Column) -> list[Column]:
    """(prefix, kind, epoch, step) of a checkpoint's file name; kind null if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(name, CHECKPOINT, i), F.lit(""))
    kind = F.when(part(4).isNotNull(), "epoch_end").when(part(3).isNotNull(), "epoch_step").otherwise(part(5))
    return [part(1).alias("prefix"), kind.alias("kind"), part(2).try_cast("int").alias("epoch"), F.coalesce(part(3), part(6)).try_cast("long").alias("step")]


def write_catalog(rows: DataFrame, path: str) -> None:
    """Member rows as catalog JSON, a family a line; paths are expected to be absolute."""
    nest_catalog(rows).select(F.array(F.struct("family_id", "seqres", "members")).alias("families")).write.json(path)


def jsonl_latest(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Records of JSON lines, the last of each key; lines that aren't JSON, or have no key, are left out."""
    own = spark.read.schema(schema).json(path).where(F.col(key).isNotNull())
    return own.groupBy(key).agg(F.max(F.struct(order, *[c for c in own.columns if c not in (key, order)])).alias("r")).select(key, "r.*")


def artifact_meta(lines: DataFrame) -> DataFrame:
    """(seqres, index) of lines of artifact metadata; what is no JSON, or lacks one of the two, is dropped."""
    own = lines.select(F.from_json("value", "seqres string, index string", {"mode": "PERMISSIVE"}).alias("m"))
    return own.select("m.seqres", "m.index").where("seqres <> '' and index <> ''")


def generation_cases(lines: DataFrame) -> DataFrame:
    """(dataset, case_id, rep, fields): cases of generation manifests, a dataset a line; what a case lacks it
    takes from its dataset; each is made n_replicates times, from 0."""
    case = "case_id: string, task: string, n_frames: int, stride: int, n_replicates: int"
    own = lines.select(F.from_json("value", f"dataset string, task string, n_frames int, stride int, n_replicates int, cases array<struct<{case}>>").alias("m"))
    c = own.select("m.*", F.explode("m.cases").alias("c"))
    pick = lambda k: F.coalesce(f"c.{k}", k)
    merged = c.select("dataset", "c.case_id", *[pick(k).alias(k) for k in ("task", "n_frames", "stride")], F.coalesce(pick("n_replicates"), F.lit(1)).alias("_n"))
    return merged.where("_n > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def declared_sequences(texts: DataFrame, name: str, text: str) -> DataFrame:
    """(name, seqres, problem) of declared sequence files, several a family: one record each, letters of the
    alphabet only, all of a family's files alike. seqres is null where there is a problem."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(F.col(text), "(?m)^>.*$", ""), r"\s", ""))
    records = F.size(F.split(F.concat(F.lit("\n"), F.col(text)), "\n>")) - 1
    own = texts.select(name, bare.alias("s"), records.alias("n"))
    g = own.groupBy(name).agg(F.max("n").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.bool_and(F.col("s").rlike("^[ACDEFGHIKLMNPQRSTVWYX]+$")).alias("ok"))
    problem = F.when(F.col("n") > 1, "records").when(F.col("a") != F.col("b"), "disagree").when(~F.col("ok"), "alphabet")
    return g.select(name, F.when(problem.isNull(), F.col("a")).alias("seqres"), problem.alias("problem"))


def obsolete_ids(lines: DataFrame) -> DataFrame:
    """(old, new) of fixed-width lines of replaced ids; lines without a replacement are skipped."""
    own = lines.select(F.trim("value").alias("v")).where(F.col("v").startswith("OBSLTE") & (F.length("v") > 30))
    return own.select(F.lower(F.substring("v", 21, 4)).alias("old"), F.lower(F.substring("v", 30, 4)).alias("new"))


def hit_table(lines: DataFrame) -> DataFrame:
    """(target, e_value) of a search's table: its first and fifth fields; comments are skipped, the last of a target counts
    by its place."""
    f = F.split(F.trim("value"), r"\s+")
    return lines.where("value <> '' and not startswith(value, '#')").select(F.element_at(f, 1).alias("target"), F.element_at(f, 5).try_cast("double").alias("e_value"))


def line_lengths(lines: DataFrame, group: str, kind: str, preferred: list[str]) -> DataFrame:
    """(group, n): lines with something in them, less the header, of the first of a group's preferred files that is there."""
    n = lines.groupBy(group, kind).agg((F.count(F.when(F.trim("value") != "", 1)) - 1).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col(kind))
    return n.where(rank > 0).groupBy(group).agg(F.min(F.struct(rank.alias("r"), "n")).alias("b")).select(group, "b.n")


def with_scores(lines: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, line) with the score of their key in columns 61 to 66; lines without a score stay as they are."""
    number = F.lpad(F.format_string("%.2f", "score"), 6, " ")
    return lines.join(scores, keys, "left").select(*keys, F.when(F.col("score").isNotNull(), F.overlay("line", number, 61, 6)).otherwise(F.col("line")).alias("line"))


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, digest) of every file in a folder or below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


def digest_manifest(lines: DataFrame) -> DataFrame:
    """(name, digest) of lines "digest  name"."""
    parts = F.split("value", "  ", 2)
    return lines.where(F.trim("value") != "").select(F.element_at(parts, 2).alias("name"), F.element_at(parts, 1).alias("digest"))
