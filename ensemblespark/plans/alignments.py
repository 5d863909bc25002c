"""Queries over aligned sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import alignments as A
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


def _columns(spark, d):
    """(chain, row_idx, col, letter): one row per letter."""
    m = view(spark, d, "msa_v")
    return m.where("seq <> ''").select("chain", "row_idx", F.posexplode(F.split("seq", "")).alias("col", "letter"))


LETTERS = "c as (select chain, row_idx, unnest(string_split(seq, '')) as letter, unnest(range(0, length(seq))) as col from msa_v where seq <> '')"


@query("align_columns", ["msa_v"], "select chain, row_idx, regexp_replace(seq, '[a-z]', '', 'g') as aligned, cast(length(seq) - length(regexp_replace(seq, '[a-z]', '', 'g')) as bigint) as inserted from msa_v")
def align_columns(spark, d):
    aligned = F.regexp_replace("seq", "[a-z]", "")
    return view(spark, d, "msa_v").select("chain", "row_idx", aligned.alias("aligned"), (F.length("seq") - F.length(aligned)).cast("long").alias("inserted"))


@query("scan_a3m", ["msa_v"], """
    p as (select chain, row_idx, string_split_regex(regexp_replace(seq, '[^a-z]', '|', 'g'), '\\|') as gaps from msa_v)
    select chain, row_idx, array_to_string(list_transform(gaps, lambda x: length(x)), ' ') as deletions from p""")
def scan_a3m(spark, d):
    gaps = F.split(F.regexp_replace("seq", "[^a-z]", "|"), "\\|")
    return view(spark, d, "msa_v").select("chain", "row_idx", F.array_join(F.transform(gaps, lambda x: F.length(x).cast("string")), " ").alias("deletions"))


@query("msa_profile", ["msa_v"], LETTERS + ", n as (select chain, col, count(*) as n from c group by chain, col) select c.chain, c.col, letter, round(count(*) / any_value(n.n), 6) as share from c join n on c.chain = n.chain and c.col = n.col group by c.chain, c.col, letter")
def msa_profile(spark, d):
    by = _columns(spark, d).groupBy("chain", "col", "letter").agg(F.count("*").alias("k"))
    total = by.groupBy("chain", "col").agg(F.sum("k").alias("n"))
    return rounded(by.join(total, ["chain", "col"]).select("chain", "col", "letter", (F.col("k") / F.col("n")).alias("share")), "share")


@query("empty_columns", ["msa_v"], LETTERS + " select chain, col from c group by chain, col having bool_and(letter = '-')")
def empty_columns(spark, d):
    return _columns(spark, d).groupBy("chain", "col").agg(F.bool_and(F.col("letter") == "-").alias("e")).where("e").select("chain", "col")


@query("dedup_sequences", ["msa_v"], "select chain, row_idx, seq from (select *, row_number() over (partition by seq order by chain, row_idx) as rn from msa_v) where rn = 1")
def dedup_sequences(spark, d):
    m = view(spark, d, "msa_v").groupBy("seq").agg(F.min(F.struct("chain", "row_idx")).alias("f"))
    return m.select("f.chain", "f.row_idx", "seq")


@query("sample_msa", ["msa_v"], """
    h as (select chain, row_idx, row_number() over (partition by chain order by case when row_idx = 0 then '' else sha256('4|' || chain || '|' || row_idx) end) as rn from msa_v)
    select chain, row_idx, rn <= 16 as sampled from h""")
def sample_msa(spark, d):
    key = F.when(F.col("row_idx") == 0, "").otherwise(F.sha2(F.concat_ws("|", F.lit("4"), "chain", F.col("row_idx").cast("string")), 256))
    return view(spark, d, "msa_v").select("chain", "row_idx", (F.row_number().over(Window.partitionBy("chain").orderBy(key)) <= 16).alias("sampled"))


@query("mask_tokens", ["msa_v"], LETTERS + """,
    m as (select chain, row_idx, col, letter, letter <> '-' and ('0x' || substr(sha256('6|' || chain || '|' || row_idx || '|' || col), 1, 12))::bigint / 281474976710656.0 < 0.15 as hit from c where chain is not null)
    select chain, row_idx, count(case when hit and letter <> 'X' then 1 end) as masked, md5(string_agg(case when hit then 'X' else letter end, '' order by col)) as digest from m group by chain, row_idx""")
def mask_tokens(spark, d):
    """Rows with a seeded share of their letters, gaps aside, replaced by X: how many, and the digest of what comes out."""
    m = view(spark, d, "msa_v").where("seq <> '' and chain is not null")
    # The coin's first sixteen hexadecimal digits against those of 0.15, as text; its prefix is made once a row.
    own = m.select("chain", "row_idx", "seq", F.concat_ws("|", F.lit("6"), "chain", F.col("row_idx").cast("string"), F.lit("")).alias("prefix"))
    hit = lambda i: F.substring(F.sha2(F.concat("prefix", i.cast("string")), 256), 1, 16) < F.lit(f"{int(0.15 * 2**64):016x}")
    letters = F.filter(F.split("seq", ""), lambda x: x != "")
    masked = own.select("chain", "row_idx", "seq", F.array_join(F.transform(letters, lambda x, i: F.when(x == "-", x).when(hit(i), "X").otherwise(x)), "").alias("new"))
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("X"), F.lit("")))
    return masked.select("chain", "row_idx", (marks(F.col("new")) - marks(F.col("seq"))).cast("long").alias("masked"), F.md5("new").alias("digest"))


@query("deletion_scale", ["msa_v"], "n as (select chain, row_idx, length(seq) - length(regexp_replace(seq, '[a-z]', '', 'g')) as n from msa_v) select chain, row_idx, round(atan(n / 3.0) * 2 / pi(), 6) as scaled, cast(least(n, 1) as int) as has from n")
def deletion_scale(spark, d):
    n = F.length("seq") - F.length(F.regexp_replace("seq", "[a-z]", ""))
    return rounded(view(spark, d, "msa_v").select("chain", "row_idx", X.deletion_scale(n).alias("scaled"), F.least(n, F.lit(1)).alias("has")), "scaled")


AGREE = """
    q as (select chain, col, letter from c where row_idx = 0),
    s as (select m.chain, m.species, m.row_idx, coalesce(k.n, 0) / greatest(1, length(f.seq)) as sim from msa_v m join msa_v f on f.chain = m.chain and f.row_idx = 0
      left join (select c.chain, c.row_idx, count(*) as n from c join q on c.chain = q.chain and c.col = q.col and c.letter = q.letter group by c.chain, c.row_idx) k on k.chain = m.chain and k.row_idx = m.row_idx)"""


@query("msa_pair", ["msa_v"], LETTERS + "," + AGREE + """,
    g as (select chain, species, count(*) as n from msa_v where species <> '' group by chain, species), e as (select species, min(n) as n from g group by species having count(*) > 1 and max(n) <= 600),
    r as (select chain, species, row_idx, row_number() over (partition by chain, species order by sim desc, row_idx) as rank from s)
    select r.species, r.rank, r.chain, r.row_idx from r join e on r.species = e.species where r.rank <= e.n""")
def msa_pair(spark, d):
    """Rows of several chains paired by species: those of equal rank in similarity to their chain's first row."""
    return A.pair_by_species(view(spark, d, "msa_v"))


@query("msa_pair_order", ["msa_v"], LETTERS + "," + AGREE + """,
    g as (select chain, species, count(*) as n from msa_v where species <> '' group by chain, species), e as (select species, min(n) as n from g group by species having count(*) > 1 and max(n) <= 600),
    r as (select chain, species, row_idx, row_number() over (partition by chain, species order by sim desc, row_idx) as rank from s)
    select r.species, r.rank, count(*) as chains, round(sum(case when row_idx > 0 then ln(row_idx) else 0 end), 6) as log_product, bool_or(row_idx = 0) as zero from r join e on r.species = e.species where r.rank <= e.n group by r.species, r.rank""")
def msa_pair_order(spark, d):
    """Paired rows with what orders them: more chains first, then the product of the rows' places (0 if one is 0)."""
    p = A.pair_by_species(view(spark, d, "msa_v")).groupBy("species", "rank")
    out = p.agg(F.count("*").alias("chains"), F.sum(F.when(F.col("row_idx") > 0, F.log("row_idx")).otherwise(0.0)).alias("log_product"), F.bool_or(F.col("row_idx") == 0).alias("zero"))
    return rounded(out, "log_product").orderBy(F.col("chains").desc(), F.col("zero").desc(), "log_product")


@query("msa_unpaired_anti", ["msa_v"], "one as (select seq from msa_v where seq is not null group by seq having count(distinct chain) = 1) select chain, row_idx from msa_v join one using (seq)")
def msa_unpaired_anti(spark, d):
    """Rows of every chain whose whole text is in no other chain."""
    m = view(spark, d, "msa_v").select("chain", "row_idx", F.sha2("seq", 256).alias("h"))
    own = F.struct("chain")  # a null chain is a chain too
    one = m.groupBy("h").agg(F.min(own).alias("a"), F.max(own).alias("b")).where(F.col("a").eqNullSafe(F.col("b"))).select("h")
    return m.where("h is not null").join(one, "h").select("chain", "row_idx")


@query("nearest_center", ["msa_v"], LETTERS + """,
    a as (select x.chain, x.row_idx, y.row_idx as center, count(*) as n from c x join c y on x.chain = y.chain and x.col = y.col and x.letter = y.letter where x.row_idx >= 8 and y.row_idx < 8 and x.letter <> '-' group by x.chain, x.row_idx, y.row_idx),
    p as (select x.chain, x.row_idx, y.row_idx as center from msa_v x join msa_v y on x.chain = y.chain where x.row_idx >= 8 and y.row_idx < 8)
    select chain, row_idx, center, agreement from (select p.*, coalesce(n, 0) as agreement, row_number() over (partition by p.chain, p.row_idx order by coalesce(n, 0) desc, p.center) as rn from p left join a using (chain, row_idx, center)) where rn = 1""")
def nearest_center(spark, d):
    """The center, one of a chain's first eight rows, that agrees with each other row in most places; gaps weigh nothing."""
    m = view(spark, d, "msa_v")
    return A.agreement(m.where("row_idx >= 8"), m.where("row_idx < 8"), gaps=False).select("chain", "row_idx", "center", "agreement")


@query("scan_fasta", ["msa_v"], "select chain, row_idx, concat('>', chain, '/', cast(row_idx as varchar)) as header, length(regexp_replace(replace(seq, '-', ''), '\\s', '', 'g')) as letters from msa_v where replace(seq, '-', '') <> ''")
def scan_fasta(spark, d):
    """Rows written as one FASTA text per chain and read back."""
    m = view(spark, d, "msa_v").where("replace(seq, '-', '') <> ''")
    record = F.concat(F.lit(">"), "chain", F.lit("/"), F.col("row_idx").cast("string"), F.lit("\x01"), F.replace("seq", F.lit("-"), F.lit("")))
    from ..sources.text import fasta_records

    r = fasta_records(m.select("chain", F.translate(record, "\n\x01", " \n").alias("text")), "text")
    return r.select("chain", F.regexp_extract("header", r"/(\d+)$", 1).cast("int").alias("row_idx"), F.concat(F.lit(">"), "header").alias("header"), F.length("sequence").cast("long").alias("letters"))


@query("crop_extra", ["msa_v"], "h as (select chain, row_idx, row_number() over (partition by chain order by sha256('8|' || chain || '|' || row_idx)) as rn from msa_v where row_idx >= 16) select chain, row_idx from h where rn <= 8")
def crop_extra(spark, d):
    key = F.sha2(F.concat_ws("|", F.lit("8"), "chain", F.col("row_idx").cast("string")), 256)
    m = view(spark, d, "msa_v").where("row_idx >= 16")
    return m.select("chain", "row_idx", F.row_number().over(Window.partitionBy("chain").orderBy(key)).alias("rn")).where("rn <= 8").drop("rn")


@query("truncate_msa", ["msa_v"], "select chain, species, row_idx from (select *, dense_rank() over (partition by chain order by f) as r from (select *, min(row_idx) over (partition by chain, species) as f from msa_v)) where r <= 2")
def truncate_msa(spark, d):
    m = view(spark, d, "msa_v")
    first = m.groupBy("chain", "species").agg(F.min("row_idx").alias("f"))
    top = first.select("chain", "species", F.dense_rank().over(Window.partitionBy("chain").orderBy("f")).alias("r")).where("r <= 2").drop("r")
    return m.join(top, ["chain", "species"], "left_semi").select("chain", "species", "row_idx")


@query("crop_chain_msa", ["msa_v"], LETTERS + "," + AGREE + """,
    g as (select chain, species, count(*) as n from msa_v where species <> '' group by chain, species), e as (select species, min(n) as n from g group by species having count(*) > 1 and max(n) <= 600),
    r as (select chain, species, row_idx, row_number() over (partition by chain, species order by sim desc, row_idx) as rank from s),
    p as (select r.chain, r.row_idx, row_number() over (partition by r.chain order by r.species, r.rank) as place from r join e on r.species = e.species where r.rank <= e.n),
    k as (select p.chain, count(*) as paired, count(case when regexp_matches(seq, '[^-]') then 1 end) as full_ from p join msa_v m on m.chain = p.chain and m.row_idx = p.row_idx where place <= 8 group by p.chain), n as (select chain, count(*) as n from msa_v group by chain)
    select n.chain, coalesce(paired, 0) as paired, least(n, greatest(16 - coalesce(full_, 0), 0)) as unpaired from n left join k on n.chain = k.chain where n.chain is not null""")
def crop_chain_msa(spark, d):
    """How many paired rows (half of sixteen at most) and unpaired rows (the rest, less the paired ones that aren't all gaps) of each chain are kept."""
    m = view(spark, d, "msa_v").where("chain is not null")
    return A.crop_sizes(m, A.pair_by_species(m), 16)
