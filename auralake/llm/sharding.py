"""Shards from fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of slots; bytes are summed per slot; a map,
stored with a version, assigns slots to shards and is edited, not rebuilt, when
bytes have shifted or shards are added.  Only the slot table, whose size is the fixed number of slots,
is handled in one place.
"""

from __future__ import annotations

import bisect
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm.storage import materialise, workspace

SLOTS = 8192


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) per row; size is the text's UTF-8 bytes (null: none) plus 8."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_bytes(measured: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes of each used slot; at most as many entries as there are slots."""
    rows = measured.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    return {r["virtual_slot"]: (r["n"], r["bytes"]) for r in rows}


def even_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1 of a map: every slot has a shard, as many slots each, before any record is seen."""
    return {k: k % shards for k in range(slots)}


def rebalance(current: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """The next version: slots move from the fullest to the emptiest shard until no move brings the two closer.

    The largest slot that still fits half the difference moves, so few slots do;
    shards added (numbers not in the map yet) start empty and are filled first.
    """
    out = dict(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        if sizes.get(slot, 0):
            held[shard].append((sizes[slot], slot))
    for of in held:
        of.sort()
    loads = [sum(size for size, _ in of) for of in held]
    while True:
        giver, taker = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        at = bisect.bisect_right(held[giver], ((loads[giver] - loads[taker]) // 2, len(out))) - 1
        if at < 0:
            return out
        size, slot = held[giver].pop(at)
        bisect.insort(held[taker], (size, slot))
        out[slot] = taker
        loads[giver] -= size
        loads[taker] += size


def save_map(spark: SparkSession, mapping: dict[int, int], version: int, path: str) -> None:
    """Store one version of the map as its own partition; an existing version is never overwritten."""
    rows = [(k, s) for k, s in sorted(mapping.items())]
    frame = spark.createDataFrame(rows, "virtual_slot int, shard int")
    frame.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, version: int, path: str) -> dict[int, int]:
    return {r["virtual_slot"]: r["shard"] for r in spark.read.parquet(f"{path}/version={version}").collect()}


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest version stored under path; 0 where there is none."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def edit_map(spark: SparkSession, sizes: dict[int, int], shards: int, path: str, slots: int = SLOTS) -> int:
    """Bring the map under path up to date with the measured slot sizes; the number of the version that holds now.

    Where none is stored, version 1 is the even map.  The latest version is
    rebalanced, and stored as the next one if a slot moves.
    """
    version = latest_version(spark, path)
    if not version:
        version = 1
        save_map(spark, even_map(shards, slots), version, path)
    current = load_map(spark, version, path)
    edited = rebalance(current, sizes, shards)
    if edited != current:
        version += 1
        save_map(spark, edited, version, path)
    return version


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot, map_version) per row of docs; bytes per shard are nearly equal.

    The map is kept under map_path (none: a new folder in the shared one), is
    edited there by edit_map and read back, so that later runs move few slots.
    slot numbers the rows of a shard from 0 without gaps: the rows of its
    earlier virtual slots are counted on the slot table, and rows are numbered
    inside their virtual slot only.  Records are hashed one by one: of a group of
    equal texts each goes to the slot of its own id, so a group of a third of all
    rows fills no shard; no law asks to keep a group together.  Null texts count
    8 bytes; null and repeated ids are hashed like others (rows equal in id and
    text share a slot); an empty table gives no rows.
    """
    spark = docs.sparkSession
    measured = materialise(measure(docs, id_col, text_col, slots), "measured")
    path = map_path or f"{workspace(spark)}/auralake/{uuid.uuid4().hex}/slot_map"
    version = edit_map(spark, {k: b for k, (_, b) in slot_bytes(measured).items()}, shards, path, slots)
    rows = measured.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `slots` rows
    slot_table = (
        spark.read.parquet(f"{path}/version={version}")
        .join(rows, "virtual_slot")
        .select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    )
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        measured.withColumn("n", F.row_number().over(w))
        .join(F.broadcast(slot_table), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "virtual_slot",
            "shard",
            (F.col("rows_before") + F.col("n") - 1).cast("long").alias("slot"),
            F.lit(version).alias("map_version"),
        )
    )
