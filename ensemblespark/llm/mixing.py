"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document gets a key, hexadecimal digits of a hash of its id and text. A source takes
whole rounds of all its documents and, for the rest of its budget, the documents whose key
is up to a threshold. The threshold comes from a histogram of sizes by source and first
digits; only the bucket in which the budget ends is refined by the next digits. Documents
are then filtered by their keys; nothing is sorted, a larger budget takes a superset, and
reruns agree.

Targets: sources in code point order, null last, weigh 5, 2, 1 and again; they share `total`
times all sizes by weight, none above `most` times its own size, the excess reshared by
weight until none is above.

Defined cases: a null or empty text has size 0 and is taken with its key; null sources are
one source; null ids hash as empty; rows equal in id and text share a key and are taken
together; the boundary key is included if that comes nearer to the target; an empty table
gives an empty result; columns besides doc_id, text and source are carried on or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import keep, small, table

WEIGHTS = (5, 2, 1)
TOTAL, MOST = 1.5, 2.0
#: Digits of the key refined at a time, and how often.
DIGITS, LEVELS = 3, 4
BLANK = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Words of a text: one more than the runs of blanks in it, once trimmed."""
    bare = F.btrim(text, F.lit(BLANK))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+")))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with size and key."""
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))), 1, DIGITS * LEVELS)
    return docs.withColumns({"size": n_words(F.col("text")).cast("long"), "key": key})


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): one row per source; a table as small as the mix's list of weights."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    # Sources reach their caps in order of cap / weight. With the first k at their caps, the
    # rest shares what they leave; the level is that of the first k at which the next cap holds.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(TOTAL) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    own = own.withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(every)["level"])
    return own.select("source", "source_size", F.least("cap", F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with rounds (0, 1 or 2: times every document is taken) and upto (key up to which one more is taken)."""
    n = goal.count()  # a row per source, as in all tables joined here
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.withColumn("rounds", full).select("*", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"), F.lit("").alias("bucket"))
    for level in range(1, LEVELS + 1):
        width = level * DIGITS
        at = small(state.select(F.col("source").alias("_s"), F.col("bucket").alias("_b")), n)
        inside = sizes.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("key", 1, width - DIGITS) == F.col("_b")))
        sums = inside.groupBy("source", F.substring("key", 1, width).alias("bucket2")).agg(F.sum("size").alias("sum"))  # at most 16 ** DIGITS rows per source
        by = Window.partitionBy("source").orderBy("bucket2")
        rolled = sums.select("source", "bucket2", "sum", F.sum("sum").over(by).alias("upto_sum"))
        joined = rolled.join(small(state.select(F.col("source").alias("_s"), "budget"), n), F.col("source").eqNullSafe(F.col("_s")))
        cut = joined.where(F.col("upto_sum") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket2", "sum", "upto_sum")).alias("cut"))
        cut = cut.select(F.col("source").alias("_s"), F.col("cut.bucket2").alias("next"), (F.col("cut.upto_sum") - F.col("cut.sum")).alias("spent"), F.col("cut.sum").alias("cut_sum"))
        # No bucket is cut where the budget covers all of it, or where there is none.
        state = state.join(small(cut, n), F.col("source").eqNullSafe(F.col("_s")), "left").select(
            *goal.columns, "rounds", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"), F.coalesce("next", F.lit("~")).alias("bucket"), F.col("cut_sum")
        )
        state = keep(state)
        last = state
        state = state.drop("cut_sum")
    # The boundary key itself: in if that overshoots by less than leaving it out falls short.
    return last.select(*goal.columns, "rounds", "bucket", (F.coalesce("cut_sum", F.lit(0)) - F.col("budget") < F.col("budget")).alias("closed"))


def plan(sizes: DataFrame) -> DataFrame:
    """The mix of documents with source, size and key: a row per source with its target and thresholds."""
    return thresholds(sizes, keep(targets(sizes)))


def apply(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """sizes' columns with source_size, target and times (how often each document is taken).
    The plan is a row per source; within small()'s limit it is broadcast and no document is shuffled."""
    planned = keep(planned)
    bound = small(planned.withColumnRenamed("source", "_s"), planned.count())
    more = ((F.col("key") < F.col("bucket")) | ((F.col("key") == F.col("bucket")) & F.col("closed"))).cast("long")
    times = F.col("rounds") + F.when(F.col("rounds") >= MOST, 0).otherwise(more)
    return sizes.join(bound, F.col("source").eqNullSafe(F.col("_s"))).select(*[F.col(f"`{c}`") for c in sizes.columns], "source_size", "target", times.alias("times"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    sizes = keep(keyed(docs).drop("text"))  # the texts are read once
    return apply(sizes, plan(sizes)).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


_WEIGHT = f"[{', '.join(map(str, WEIGHTS))}]"
OP7_SQL = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, {DIGITS * LEVELS}) as key
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, {MOST} * cast(sum(size) as double) as cap,
         cast({_WEIGHT}[(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as double) as weight
  from d group by source
), l as (
  select *, ({TOTAL} * sum(cast(source_size as double)) over () - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
  from s window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), f as (
  select arg_min(level, cap / weight) as level from l where level <= cap / weight
), g as (
  select source, source_size, least(cap, coalesce((select level from f), cast('inf' as double)) * weight) as target from l
), r as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as rounds from g
), k as (
  select source, key, sum(size) as own, sum(sum(size)) over (partition by source order by key) as upto from d group by source, key
), c as (
  select k.source, min(key) as cut, min(upto - own) as spent, arg_min(own, key) as own
  from k join r on k.source is not distinct from r.source where upto > target - rounds * source_size group by k.source
)
select d.doc_id, d.size, r.source_size, r.target,
       d.size * (rounds + case when rounds >= {MOST} then 0 when d.key < coalesce(cut, '~') then 1
         when d.key = cut and own - (target - rounds * source_size - spent) < target - rounds * source_size - spent then 1 else 0 end) as taken
from d join r on d.source is not distinct from r.source left join c on d.source is not distinct from c.source
"""
