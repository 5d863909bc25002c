"""A corpus pipeline: classify, apply rules, remove near-duplicates, mix, tokenise.

Each stage works on all documents that the one before kept, and its decisions take effect.
All but the last return the columns of documents. Cases are defined as in the operators'
modules: rows with null columns, empty texts, ties and repeats run through every stage; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblespark.llm import bpe, mixing, near_dedup, quality, rules
from ensemblespark.llm.store import keep, small, table


def _whole(docs: DataFrame):
    """The document as one column, beside which no name can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, doesn't reject. It judges by text
    and n_chars, so the rejected ones are a set of those."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    size = F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0)).alias("_size")
    own = docs.select("text", F.col("n_chars"), _whole(docs)).select(size, *rules.text_key(), "row")
    scored = quality.score(docs.select("doc_id", "text", "n_chars", size, *rules.text_key()), machine, also=("_size", "t1", "t2"))
    gone = keep(scored.where("predicted = 0").select("_size", "t1", "t2").distinct())
    return own.join(small(gone, gone.count()), ["_size", "t1", "t2"], "left_anti").select("row.*")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose distributions fit their language. What the rules
    decide on is the text and the language, so the rejected ones are a set of those."""
    own = docs.select("text", "lang", _whole(docs)).select("lang", *rules.text_key(), "row").withColumn("_n", F.col("lang").isNull()).withColumn("_l", F.coalesce("lang", F.lit("")))
    judged = rules.judge(docs.select("text", "lang")).where("not kept").select(F.coalesce("lang", F.lit("")).alias("_l"), F.col("lang").isNull().alias("_n"), "t1", "t2").distinct()
    gone = keep(judged)
    return own.join(small(gone, gone.count()), ["_l", "_n", "t1", "t2"], "left_anti").select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of least doc_id; of rows that are equal
    in doc_id and text, the least when written as JSON."""
    key = ["doc_id", "t1", "t2"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _whole(docs)).select("doc_id", *near_dedup.text_key(), "row")
    judged = near_dedup.groups(docs.select("doc_id", "text")).groupBy(key).agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    noted = keep(judged.where("not kept or times > 1"))
    n = noted.count()
    # A null id equals no id in a join; a flag beside it does.
    match = lambda df: df.select("*", F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"))
    on = ["_d", "_n", "t1", "t2"]
    kept = match(own).join(small(match(noted).select(*on), n), on, "left_anti").select("row")
    again = noted.where("kept")
    if again.take(1):  # rows equal in id and text
        kept = kept.union(match(own).join(small(match(again).select(*on), n), on).groupBy(on).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return kept.select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    own = mixing.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", _whole(docs)))
    planned = mixing.plan(keep(own.select("source", "size", "key")))
    return mixing.apply(own.drop("text", "doc_id"), planned).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("MinHash near-dedup", remove_near_duplicates),
    ("mixing sources", mix),
    ("byte-level BPE", tokenise),
]

#: Training, ProbMinHash and merges are beyond SQL; tests/llm/test_pipeline.py holds each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; what each but the last returns is kept as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs)
    return docs
