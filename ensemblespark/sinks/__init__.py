"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A set of ids up to this many rows (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and everything runs on this machine,
    a folder of our own. On a cluster an unset folder is an error: no local one is shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later steps neither repeat
    its work nor depend on an executor that made it. The shuffles that made it are deleted once
    it is written, the files themselves when Spark ends or by forget()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by keep() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if not files:
            continue
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if rows <= limit else df


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that a job writes; it goes when Spark ends."""
    path = f"{shared_folder(spark)}/kept-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def write_lines(lines: DataFrame, column: str, path: str, order: list[str] | None = None) -> str:
    """A column of text as the lines of text files; with order, lines in that order in files by ranges of it."""
    own = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    own.select(F.col(column).alias("value")).write.text(path)
    return path


def write_split(assignment: DataFrame, meta: dict, path: str) -> None:
    """An assignment (family_id, split), in order of families, by split; and a row of what describes it."""
    assignment.repartitionByRange("family_id").sortWithinPartitions("family_id").write.partitionBy("split").parquet(f"{path}/assignment")
    spark = assignment.sparkSession
    spark.createDataFrame([tuple(map(str, meta.values()))], ", ".join(f"{k} string" for k in meta)).write.json(f"{path}/meta")


def write_selection(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV with a header and the columns in a fixed order."""
    rows.select(*columns).write.option("header", True).csv(path)


def append_progress(records: DataFrame, path: str) -> None:
    """One JSON line per finished unit, appended to those written before."""
    records.write.mode("append").json(path)
