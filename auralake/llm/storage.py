"""Intermediate tables in the folder that the cluster shares, and joins chosen by a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of one long column that a join may broadcast (about 16 MB).
BROADCAST_ROWS = 1_000_000
#: Whole texts that a Python worker holds at once.
TEXT_BATCH = 1_000


def workspace(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster,
    whose executors do not share the driver's disk, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, batch: int = 10_000) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: short lineage that survives lost executors.

    batch: most rows that a Python worker holds at once meanwhile; TEXT_BATCH for
    jobs that read whole texts.
    """
    path = f"{workspace(df.sparkSession)}/auralake/{uuid.uuid4().hex}/{name}"
    with _batches_of(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str, text_col: str) -> Column:
    """64 bits of id and text: the identity of a row whose id may be null or stand twice."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def id_text(id_col: str, name: str = "doc_id") -> Column:
    """An id column on its way through pandas, which would round large ids beside nulls."""
    return F.col(id_col).cast("long").cast("string").alias(name)


def id_long(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """df with an id_text column as the number that it was."""
    return df.withColumn(name, F.col(name).cast("long"))


def filter_by_ids(df: DataFrame, ids: DataFrame, column: str | list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a materialised table of ids, of one or more long columns.

    The ids are counted first: up to BROADCAST_ROWS they are broadcast, which
    leaves wide rows where they are; beyond that both sides are shuffled.
    """
    small = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, column, how)


def join_hot_apart(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keyed, a materialised table of one row per key with its number n of rows.

    Keys with more than a ten-thousandth of `total` rows (and over a thousand)
    are at most ten thousand; they are broadcast, so rows of a hot key stay
    where they are, and only the others are shuffled by key.
    """
    least = max(1_000, total // 10_000)
    hot = materialise(keyed.filter(F.col("n") > least).drop("n"), "hot")
    cold = keyed.filter(F.col("n") <= least).drop("n")
    spread = rows.join(F.broadcast(hot), key)
    return spread.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
