"""Views of the given tables in the shape of the engine's data model.

Each view is one SQL text that Spark and DuckDB both read; `{elt}` is the engine's name for
taking an array's element by its 1-based place, `{range}` for a table of whole numbers,
`{join}(` for joining texts where nulls count as empty, `{trim}` for text without spaces at its ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import ranked

#: What DuckDB's trim takes off, the separators of Unicode's category Zs; Spark's takes off the first alone.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Names that differ: in Spark, in DuckDB.
ENGINE = {"{elt}": ("element_at", "list_extract"), "{join}(": ("concat_ws('', ", "concat("), "{trim}": (f"trim(both '{SPACES}' from text)", "trim(text)")}

_UPPER = "abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ"

VIEWS = {
    # identity atoms: one row per family
    "families_v": f"""
        select {{join}}(lpad(cast(doc_id as string), 8, '0'), '_', lang) as family_id, doc_id,
               translate({{trim}}, '{_UPPER}') as seqres, source, lang
        from documents""",
    # members of a family, static or trajectory
    "members_v": """
        select l_orderkey as family_id, l_linenumber as member_id,
               concat('/store', cast(l_suppkey % 3 as string), '/', cast(l_partkey as string)) as path,
               l_returnflag = 'N' as is_trajectory, cast(l_quantity * 100 as int) as n_frames
        from lineitem""",
    # one observable per frame of a replica
    "trajectory_v": """
        select concat('f', cast(user_id % 20 as string)) as family_id, user_id as replica,
               cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx, value, event_type as segment
        from events""",
    "vectors_v": """
        select label as ensemble_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) as frame_idx, embedding
        from embeddings""",
    # points of a frame, long
    "frames_v": """
        select ensemble_id, frame_idx, res_idx,
               cast({elt}(embedding, 3 * res_idx + 1) as double) * 25 as x, cast({elt}(embedding, 3 * res_idx + 2) as double) * 25 as y, cast({elt}(embedding, 3 * res_idx + 3) as double) * 25 as z
        from vectors_v cross join (select distinct cast(l_linenumber * 3 + k - 3 as int) as res_idx from (select distinct l_linenumber from lineitem where l_linenumber <= 7) n cross join (select 0 as k union all select 1 union all select 2) o) r""",
    # tokens of a cluster
    "clusters_v": """
        select p_brand as cluster_id, l_orderkey, l_linenumber as line_no,
               case when (l_orderkey + l_linenumber) % 7 = 0 then concat('AF_AF', lpad(cast(l_suppkey as string), 6, '0'), '_', cast(p_size as string))
                    else concat(lpad(cast(l_suppkey as string), 4, '0'), '_', cast(p_size as string)) end as token,
               p_retailprice / 500 as rmsd, p_size * 10 as seqlen, l_discount * 10 as identity,
               case l_linenumber % 4 when 0 then 'ok' when 1 then 'failed' when 2 then 'rejected' else 'ok' end as status
        from lineitem join part on l_partkey = p_partkey""",
    # lists of ids that a selection must avoid
    "exposure_v": """
        select distinct 'suppliers' as list_name, lpad(cast(s_suppkey as string), 4, '0') as id from supplier where s_suppkey % 5 = 0
        union all select distinct 'labels', cast(doc_id as string) from labels where toxic = 1
        union all select distinct 'benchmark', cast(item_id as string) from benchmark""",
    # one metric value per arm, family and seed
    "arms_v": """
        select l_returnflag as arm, n_name as family, l_linenumber as seed, avg(l_extendedprice) as price, avg(l_discount) as discount, avg(l_tax) as tax
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        group by l_returnflag, n_name, l_linenumber""",
    # a run log, one line per step; the value goes into the line with four digits
    "log_v": """
        select concat('run', cast(user_id % 4 as string)) as run, event_id as line_no,
               case when event_type = 'view' then concat('[val] epoch=', cast(event_id % 7 as string), ' step=', cast(event_id % 5000 as string), ' val_loss=', cast(cast(value as decimal(18,4)) as string))
                    else concat('[step ', cast(event_id % 5000 as string), '] samples=', cast(event_id * 8 as string), ' lr=0.0001 train_loss(mean over ', cast(user_id % 9 + 1 as string), ')=', cast(cast(value as decimal(18,4)) as string)) end as line,
               value, event_type
        from events""",
    # aligned rows of a chain
    "msa_v": """
        select source as chain, lang as species, cast(row_number() over (partition by source order by doc_id) - 1 as int) as row_idx,
               replace(text, ' ', '-') as seq, doc_id
        from documents""",
}

#: Views that a view reads.
NEEDS = {"frames_v": ["vectors_v"]}
TABLES = {
    "families_v": ["documents"], "members_v": ["lineitem"], "trajectory_v": ["events"], "vectors_v": ["embeddings"], "frames_v": ["vectors_v", "lineitem"],
    "clusters_v": ["lineitem", "part"], "exposure_v": ["supplier", "labels", "benchmark"], "arms_v": ["lineitem", "supplier", "nation"], "log_v": ["events"], "msa_v": ["documents"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables in sf_dir."""
    if name == "msa_v":
        return _msa(spark, sf_dir)
    text = _worded(VIEWS[name], 0)
    sources = {t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    for t in sources:
        text = _named(text, t)
    return spark.sql(text, **sources)


def _msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msa_v with its rows numbered so that no one task sorts a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("source").alias("chain"), F.col("lang").alias("species"), F.replace("text", F.lit(" "), F.lit("-")).alias("seq"), "doc_id")
    return ranked(rows, ["chain"], ["doc_id"], "place").select("chain", "species", (F.col("place") - 1).cast("int").alias("row_idx"), "seq", "doc_id")


def _worded(text: str, engine: int) -> str:
    for mark, names in ENGINE.items():
        text = text.replace(mark, names[engine])
    return text


def _named(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", text)


def oracle(views: list[str], body: str) -> str:
    """DuckDB SQL: the views as common tables, then body (a select, or more common tables and a select)."""
    every = list(dict.fromkeys(v for name in views for v in [*NEEDS.get(name, []), name]))
    tables = ",\n".join(f"{v} as ({_worded(VIEWS[v], 1)})" for v in every)
    body = body.strip()
    return f"with {tables}{' ' if body.startswith('select') else ', '}{body}"
