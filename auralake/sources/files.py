"""Readers and writers: metadata CSV, audio file trees, partitioned datasets, guarded overwrite."""

from __future__ import annotations

import hashlib
import io
import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auralake.operators.ordering import new_folder, numbered
from auralake.plans.registry import Views, query


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header CSV as typed columns; a byte-order mark before the first name is ignored, missing columns are null.

    Columns are matched by name, values that don't parse become null.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return raw.select(*[(F.expr(f"try_cast(`{n}` AS {t})") if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def scan_audio(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, label, size): every audio file below folder, its parent folder as label; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("label"), F.col("length").alias("size"))


def decode_wav(raw: bytes) -> tuple[np.ndarray, int, int]:
    """(samples as (frames, channels) in [-1, 1], rate, bits) of PCM WAV bytes."""
    with wave.open(io.BytesIO(raw)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        data = w.readframes(w.getnframes())
    if width == 1:
        y = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        y = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        y = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return y.reshape(-1, channels), rate, 8 * width


def probe_audio(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """probe_contents of every audio file below folder."""
    return probe_contents(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder))


def wav_bytes(samples: Column, rate: int) -> Column:
    """A mono WAV file of 8-bit samples (a binary column), header and data."""
    le = lambda n, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * size, "0"), F.lit("(..)"))), ""))  # noqa: E731  little-endian
    n = F.octet_length(samples).cast("long")
    word = lambda x, size: le(F.lit(x).cast("long"), size)
    parts = [F.encode(F.lit("RIFF"), "UTF-8"), le(n + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), word(16, 4), word(1, 2), word(1, 2), word(rate, 4), word(rate, 4), word(1, 2), word(8, 2)]
    return F.concat(*parts, F.encode(F.lit("data"), "UTF-8"), le(n, 4), samples)


def probe_contents(files: DataFrame) -> DataFrame:
    """Format, duration, rate, channels, bits, size, peak and sha256 of every file (path, content); one that can't be decoded has a reason in `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                digest = hashlib.sha256(raw).hexdigest()
                try:
                    y, rate, bits = decode_wav(raw)
                    rows.append((path, "wav", len(y) / rate, rate, y.shape[1], bits, len(raw), float(np.abs(y).max(initial=0)), digest, None))
                except (wave.Error, EOFError, ValueError, KeyError) as e:
                    rows.append((path, None, None, None, None, None, len(raw), None, digest, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "format", "duration_s", "sample_rate", "channels", "bit_depth", "size", "peak", "sha256", "error"])

    return files.select("path", "content").mapInPandas(
        run, "path string, format string, duration_s double, sample_rate int, channels int, bit_depth int, size long, peak double, sha256 string, error string"
    )


def write_dataset(rows: DataFrame, path: str, by: tuple[str, ...] = ("split", "class_name"), force: bool = False) -> None:
    """Rows partitioned by split and class; an existing dataset is replaced only when forced."""
    rows.repartition(*by).write.partitionBy(*by).mode("overwrite" if force else "errorifexists").parquet(path)


def write_csv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as CSV with a header; in a given order over all files, whose names follow it."""
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def write_metadata(rows: DataFrame, rejected: DataFrame, stats: DataFrame, path: str, order: list[str]) -> None:
    """The tables of a dataset below path: rows in order, rejected rows by path, and statistics as JSON lines."""
    write_csv(rows, f"{path}/dataset_metadata", order)
    write_csv(rejected, f"{path}/rejected_files", ["source_path"])
    write_summary(stats, f"{path}/dataset_statistics")


def write_features(parts: DataFrame, path: str, names: list[str], settings: dict) -> DataFrame:
    """Feature rows (ids and an array column `features`) as Parquet, names and settings beside them as JSON; one row: rows, and values that are no finite numbers.

    Values are checked as they are written, by an observation of the same pass.
    """
    seen = Observation()
    bad = F.size(F.filter("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    watched = parts.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    watched.write.mode("errorifexists").parquet(f"{path}/features")
    spark = parts.sparkSession
    side = spark.createDataFrame([(json.dumps({"names": names, "settings": settings}, sort_keys=True),)], "value string")
    side.coalesce(1).write.mode("errorifexists").text(f"{path}/description")
    found = seen.get
    return spark.createDataFrame([(found["rows"], found["bad"])], "rows long, bad long")


def write_export(rows: DataFrame, path: str, columns: tuple[tuple[str, str], ...]) -> None:
    """Rows as CSV for spreadsheets: (heading, column) in order, a byte-order mark before the first heading of every file."""
    named = [F.col(c).alias(("\ufeff" if i == 0 else "") + heading) for i, (heading, c) in enumerate(columns)]
    rows.select(*named).write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def read_export(spark: SparkSession, path: str, schema: StructType, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    """The rows of write_export under their column names and types."""
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
    return raw.select(*(F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(c) if kinds[c] == "string" else F.expr(f"try_cast(`{h}` AS {kinds[c]})").alias(c) for h, c in columns))


def write_summary(stats: DataFrame, path: str) -> None:
    """Statistics as JSON lines."""
    stats.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def scratch(spark: SparkSession) -> str:
    return new_folder(spark, "files")


@query("io1_csv_round_trip", "SELECT clip_no, path, class_name, duration_s FROM {clips}")
def _io1(v: Views) -> DataFrame:
    path = scratch(v.spark)
    write_csv(v.clips.select("clip_no", "path", "class_name", "duration_s"), path)
    return read_metadata(v.spark, path, "clip_no bigint, path string, class_name string, duration_s double")


@query(
    "io4_probed_recordings",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN 'wav' END AS format, CASE WHEN doc_id % 10 <> 3 THEN n / 8000 END AS duration_s, CASE WHEN doc_id % 10 <> 3 THEN 8000 END AS sample_rate,
    CASE WHEN doc_id % 10 = 3 THEN 20 ELSE n + 44 END AS size, doc_id % 10 = 3 AS broken FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)""",
)
def _io4(v: Views) -> DataFrame:
    """The bytes of every document as a WAV file; every tenth is cut off in its header."""
    whole = wav_bytes(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 8000)
    files = v.documents.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 10 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("content"))
    found = probe_contents(files)
    return found.select(F.col("path").cast("long").alias("doc_id"), "format", "duration_s", "sample_rate", "size", F.col("error").isNotNull().alias("broken"))


@query("io5_partitioned_dataset", "SELECT split, class_name, count(*) AS n FROM {clips} GROUP BY ALL")
def _io5(v: Views) -> DataFrame:
    path = scratch(v.spark)
    write_dataset(v.clips.select("clip_no", "split", "class_name"), path)
    return v.spark.read.parquet(path).groupBy("split", "class_name").agg(F.count("*").alias("n"))


@query(
    "io6_ordered_tables",
    """SELECT 'row' AS kind, clip_no, path, row_number() OVER (ORDER BY class_name, path) AS place FROM {clips} WHERE duration_s >= 0.3 UNION ALL
    SELECT 'rejected', clip_no, path, row_number() OVER (ORDER BY path) FROM {clips} WHERE duration_s < 0.3""",
)
def _io6b(v: Views) -> DataFrame:
    """Written in order; the place of a row is counted over the files by name and the lines of each."""
    path = scratch(v.spark)
    kept = v.clips.filter("duration_s >= 0.3").select("clip_no", "path", "class_name", "duration_s")
    rejected = v.clips.filter("duration_s < 0.3").select("clip_no", F.col("path").alias("source_path"), F.lit("too short").alias("reason"))
    write_metadata(kept, rejected, kept.groupBy("class_name").agg(F.count("*").alias("n")), path, ["class_name", "path"])

    def placed(folder: str, kind: str, name: str) -> DataFrame:
        lines = v.spark.read.option("header", True).csv(f"{path}/{folder}").withColumns({"_f": F.input_file_name(), "_i": F.monotonically_increasing_id()})
        return numbered(lines, [], ["_f", "_i"], "place").select(F.lit(kind).alias("kind"), F.col("clip_no").cast("long").alias("clip_no"), F.col(name).alias("path"), "place")

    return placed("dataset_metadata", "row", "path").unionByName(placed("rejected_files", "rejected", "source_path"))


@query(
    "io8_feature_store",
    "SELECT count(*) AS rows, CAST(count(*) FILTER (vec_id % 9 = 0) + 2 * count(*) FILTER (vec_id % 10 = 0) AS BIGINT) AS bad, 'e0,e1' AS first_names, count(*) AS stored FROM embeddings",
)
def _io8(v: Views) -> DataFrame:
    """Some values spoilt before they are written; the stored rows and the description are read back."""
    path = scratch(v.spark)
    spoilt = F.concat(
        F.col("embedding").cast("array<double>"), F.when(F.col("vec_id") % 9 == 0, F.array(F.lit(float("nan")))).otherwise(F.array().cast("array<double>")),
        F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(float("inf")), F.lit(None).cast("double"))).otherwise(F.array().cast("array<double>")),
    )
    health = write_features(v.embeddings.select("vec_id", spoilt.alias("features")), path, [f"e{i}" for i in range(64)], {"rate": 16000})
    names = v.spark.read.text(f"{path}/description").select(F.array_join(F.slice(F.from_json("value", "names array<string>")["names"], 1, 2), ",").alias("first_names"))
    stored = v.spark.read.parquet(f"{path}/features").agg(F.count("*").alias("stored"))
    return health.crossJoin(names).crossJoin(stored)  # one row each


@query("io6_json_summary", "SELECT class_name, count(*) AS n FROM {clips} GROUP BY class_name")
def _io6(v: Views) -> DataFrame:
    path = scratch(v.spark)
    write_summary(v.clips.groupBy("class_name").agg(F.count("*").alias("n")), path)
    return v.spark.read.text(path).select(F.from_json("value", "class_name string, n bigint").alias("j")).select("j.*")
