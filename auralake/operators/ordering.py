"""Exact row numbers per key without one task per key, and tables settled in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors reach.

    Where that is unset, a local session uses the warehouse; on a cluster, whose
    executors need not share the driver's disk, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/auralake-{purpose}/{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str = "tables") -> DataFrame:
    """df written to the shared folder and read back: computed once, and still there when an executor is lost."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """rows with _id, which rises in the order of keys and `order`, and _part, the range partition that a row lies in; settled.

    A key of any size is spread over parts, and what a part tells of a key is one
    row; so a scan along a key is one within the parts and one over these rows.
    """
    places = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    spread = rows.repartitionByRange(*places).sortWithinPartitions(*places)
    return settled(spread.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "row_no") -> DataFrame:
    """rows with their number from 1 inside `keys` in a total order.

    The numbers inside a part are moved up by the rows that the key has in
    earlier parts.  Only that table, of at most keys + parts rows, goes through a
    window.
    """
    spread = placed(rows, keys, order)
    counts = spread.groupBy(*keys, "_part").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    joined = spread.join(starts, [*keys, "_part"])
    return joined.withColumn(name, F.col("_id") - F.col("_low") + F.col("_before") + 1).select(*rows.columns, name)


def in_chunks(rows: DataFrame, micros: str, width: int, behind: int = 0, ahead: int = 0) -> DataFrame:
    """rows with _own, the chunk of time that a row lies in, and _chunk, once for every chunk that sees it.

    A chunk of `width` microseconds sees the rows of `behind` before and `ahead` after it, too.
    """
    number = lambda t: ((t - F.pmod(t, F.lit(width))) / width).cast("long")  # noqa: E731  exact: the difference is a multiple
    t = F.col(micros)
    seen = F.sequence(number(t - ahead), number(t + behind))
    return rows.withColumn("_own", number(t)).withColumn("_chunk", F.explode(seen))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows (counted here); give it a few narrow columns."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, hot: int = 10_000) -> DataFrame:
    """rows joined with keyed, one row per key with its number n of rows.

    Keys with more than a hot-th of all rows, fewer than `hot` of them, are
    broadcast, so their rows stay where they are; the others are shuffled by key.
    """
    keyed = settled(keyed)
    least = F.greatest(F.lit(1_000), F.lit(rows.count() / hot))
    often, seldom = keyed.filter(F.col("n") > least), keyed.filter(F.col("n") <= least)
    spread = rows.join(F.broadcast(often), key)
    return spread.unionByName(rows.join(F.broadcast(often.select(key)), key, "left_anti").join(seldom, key))
