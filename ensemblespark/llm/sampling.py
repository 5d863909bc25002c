"""A bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import id_fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str], even: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """Up to per_class labelled documents of each class, with columns `label`, `fold` and those
    asked for, and the number of labelled ids by class.

    Only ids whose crc32 modulo 4 is not 2 are used. Ids are taken in order of a hash, so the
    sample is the same in every run and independent of the layout. An id labelled more than
    once counts once, with the larger label. Null ids and labels are left out. The chosen ids
    are at most 2 * per_class (with even=True as many of each class), hence the broadcast. Of several
    rows with a sampled id the one with the least hash of its columns is taken, so the sample has at
    most 2 * per_class rows; only sampled rows are shuffled.
    """
    own = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & (id_fold("_id", 4) != 2))
        .groupBy("_id").agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if even:
        per_class = min(per_class, counts.get(0, 0), counts.get(1, 0))
    parts = [own.where(F.col("label") == c).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).withColumn("fold", id_fold("_id", 4))
    picked = docs.select(F.col("doc_id").alias("_id"), *[F.col(c) for c in columns])
    picked = picked.join(F.broadcast(chosen), "_id").select("_id", "label", "fold", F.struct(F.xxhash64(*columns).alias("_h"), *columns).alias("r"))
    one = picked.groupBy("_id", "label", "fold").agg(F.min("r").alias("r"))
    return one.select("_id", "label", "fold", *[F.col(f"r.{c}").alias(c) for c in columns]), counts
