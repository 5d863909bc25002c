"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Logs often hold a conversation again after every turn. Each conversation's turns are ordered
by (turn, role, text); a rolling hash over them, of 128 bits, names every prefix. Equal
conversations become one, under their least id; one whose whole hash is the hash of a proper
prefix of a longer conversation is a snapshot and goes by an anti-join. What remains is
rendered with a start and an end mark around each turn.

Hashes are exclusive-ors of position-salted turn hashes, so a window function rolls them on
without holding a conversation in memory; all joins and groupings but the rendering move
hashes, not texts, and join tables with one row per hash, so a first turn or conversation
that very many share costs one row per task.

Defined cases: null roles and texts count as empty; null turns come first; equal rows of a
conversation are turns of their own; each row without a conv_id is a conversation of one
turn, its id null unless an equal one has an id; columns besides conv_id, turn, role and text
are ignored; turns and conversations of any length are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, table

START, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """(owner, conv_id, place, n, role, text, h1, h2): every turn with the hash of the prefix it ends."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = t.withColumn("owner", F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("~"), F.md5(F.concat_ws("\x00", "role", "text")))))
    hashes = [F.xxhash64("place", "role", "text").alias("t1"), F.xxhash64("text", "role", "place", F.lit(17)).alias("t2")]
    by = Window.partitionBy("owner").orderBy("turn", "role", "text")
    placed = own.where("conv_id is not null").select("*", F.row_number().over(by).alias("place"), F.count("*").over(Window.partitionBy("owner")).cast("int").alias("n"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    columns = ["owner", "conv_id", "place", "n", "role", "text"]
    rolled = placed.select("*", *hashes).select(*columns, F.bit_xor("t1").over(upto).alias("h1"), F.bit_xor("t2").over(upto).alias("h2"))
    # Rows without a conversation need no order, so very many equal ones don't meet in a task.
    lone = own.where("conv_id is null").select("*", F.lit(1).alias("place"), F.lit(1).alias("n")).select("*", *hashes)
    return rolled.unionByName(lone.select(*columns, F.col("t1").alias("h1"), F.col("t2").alias("h2")))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    t = keep(prefixes(turns))
    whole = t.where(F.col("place") == F.col("n")).groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min("owner").alias("owner"), F.count("*").alias("n_copies"))
    # An id, if there is one, names the owner to render; else any row without one does.
    whole = whole.withColumn("owner", F.coalesce(F.col("conv_id").cast("string"), "owner"))
    shorter = t.where(F.col("place") < F.col("n")).select(F.col("place").cast("long").alias("n"), "h1", "h2").distinct()
    maximal = whole.withColumn("n", F.col("n").cast("long")).join(shorter, ["n", "h1", "h2"], "left_anti").select("owner", F.col("conv_id").alias("id"), "n", "n_copies")
    line = F.concat(F.lit(START), F.col("x.role"), F.lit("\n"), F.col("x.text"), F.lit(END + "\n"))
    rendered = (
        t.select("owner", F.struct("place", "role", "text").alias("x")).join(maximal, "owner")
        .withColumn("x", F.struct(F.col("x.place").alias("place"), line.alias("line")))
        .groupBy("owner", "id", "n", "n_copies").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    )
    return rendered.select(F.col("id").alias("conv_id"), F.col("n").alias("n_turns"), "n_copies", F.array_join(F.transform("xs", lambda x: x["line"]), "").alias("rendered"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP1_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), c as (
  select conv_id, list(role || chr(0) || text order by turn nulls first, role, text) as turns, count(*) as n,
         string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' order by turn nulls first, role, text) as rendered
  from t group by conv_id
), w as (
  select turns, n, min(conv_id) as conv_id, count(*) as n_copies, min(rendered) as rendered from c group by turns, n
), p as (
  select distinct list_slice(turns, 1, k) as turns from (select turns, n, unnest(range(1, n)) as k from w)
)
select conv_id, n as n_turns, n_copies, rendered from w where turns not in (select turns from p)
"""
