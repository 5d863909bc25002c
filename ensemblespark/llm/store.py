"""Tables, kept tables and folds, as the operators of this subpackage use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import BROADCAST_ROWS, forget, keep, shared_folder, small

__all__ = ["BROADCAST_ROWS", "forget", "id_fold", "keep", "shared_folder", "small", "table"]


def id_fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds, F.lit(-1)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
