"""Published versions of a dataset: data files that never change, and one small manifest per version.

A version lists folders, one per part of the dataset (a value of the partition
column) and commit.  Adding rows adds folders; replacing parts names new folders
for these and keeps the others; so a commit writes what it changes only.  A
version comes to be by renaming its finished manifest to its number, which fails
if the number is taken: of two writers on one base, the second gets a
VersionConflict, and what a failed writer leaves is in no version.  Readers keep
the version that they opened.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators.ordering import settled
from auralake.plans.registry import Views, query

_PART = "auralake_part"


class VersionConflict(Exception):
    """Another writer has published the version first."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the newest version; 0 without any."""
    jvm, place, fs = _files(spark, f"{path}/versions")
    if not fs.exists(place):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    if not version:
        return {"by": None, "schema": None, "folders": []}
    return json.loads(spark.read.text(f"{path}/versions/{version:09d}.json", wholetext=True).first()[0])  # a line per folder


def _commit(spark: SparkSession, path: str, base: int, manifest: dict) -> int:
    jvm, draft, fs = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest, indent=0).encode()))
    finally:
        out.close()
    number = base + 1
    goal = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:09d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    try:
        context.rename(draft, goal, jvm.java.lang.reflect.Array.newInstance(kind, 0))
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise VersionConflict(f"version {number} of {path} is there already") from None
        raise
    return number


def publish(rows: DataFrame, path: str, by: str, base: int | None = None, replace: bool = False) -> int:
    """The number of the new version: the base version (the latest unless given) with rows added.

    With replace, every part (value of column `by`) that rows have is replaced by
    them as a whole; parts without rows stay.  Rows of a null part make a part of
    their own.  The columns must be those of the versions before.
    """
    spark = rows.sparkSession
    base = latest_version(spark, path) if base is None else base
    before = _manifest(spark, path, base)
    schema = rows.schema.jsonValue()
    if base and (before["by"] != by or [(f["name"], f["type"]) for f in before["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema["fields"]]):
        raise ValueError("columns or parts differ from the versions before")
    commit = uuid.uuid4().hex
    part = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null"))
    named = rows.withColumn(_PART, F.substring(F.md5(part), 1, 16))
    named.repartition(_PART, F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.partitionBy(_PART).parquet(f"{path}/data/{commit}")  # a part of any size goes to up to 16 tasks
    jvm, place, fs = _files(spark, f"{path}/data/{commit}")
    new = sorted(f.getPath().getName().split("=")[1] for f in fs.listStatus(place) if f.isDirectory())
    kept = [f for f in before["folders"] if not (replace and f["part"] in new)]
    return _commit(spark, path, base, {"by": by, "schema": schema, "folders": [*kept, *({"commit": commit, "part": p} for p in new)]})


def drop_parts(spark: SparkSession, path: str, values: list[str | None], base: int | None = None) -> int:
    """The number of a new version without the parts of the given values."""
    import hashlib

    base = latest_version(spark, path) if base is None else base
    manifest = _manifest(spark, path, base)
    gone = {hashlib.md5(("null" if v is None else f"={v}").encode()).hexdigest()[:16] for v in values}
    return _commit(spark, path, base, manifest | {"folders": [f for f in manifest["folders"] if f["part"] not in gone]})


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the latest unless given."""
    from pyspark.sql.types import StructType

    manifest = _manifest(spark, path, latest_version(spark, path) if version is None else version)
    if manifest["schema"] is None:
        raise ValueError(f"nothing is published at {path}")
    schema = StructType.fromJson(manifest["schema"])
    commits: dict[str, list[str]] = {}
    for f in manifest["folders"]:
        commits.setdefault(f["commit"], []).append(f"{path}/data/{f['commit']}/{_PART}={f['part']}")
    frames = [spark.read.schema(schema).parquet(*folders) for folders in commits.values()]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


@query(
    "s2_published_versions",
    """WITH a AS (SELECT 1 AS version, clip_no, class_name, duration_s FROM {clips} WHERE clip_no % 3 = 0),
    b AS (SELECT 2 AS version, clip_no, class_name, duration_s FROM a UNION ALL SELECT 2, clip_no, class_name, duration_s FROM {clips} WHERE clip_no % 3 = 1),
    c AS (SELECT 3 AS version, clip_no, class_name, duration_s FROM b WHERE class_name <> 'BUILDING' UNION ALL SELECT 3, clip_no, class_name, duration_s * 2 FROM {clips} WHERE class_name = 'BUILDING'),
    d AS (SELECT 4 AS version, clip_no, class_name, duration_s FROM c WHERE class_name NOT IN ('MACHINERY', 'none'))
    SELECT version, class_name, count(*) AS n, round(sum(duration_s), 3) AS seconds, min(clip_no) AS first_clip FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY version, class_name""",
)
def _s2(v: Views) -> DataFrame:
    """A dataset, an extension of it, a class replaced and a class dropped; every version is read back afterwards."""
    from auralake.sources.files import scratch

    path = scratch(v.spark)
    clips = settled(v.clips.select("clip_no", "class_name", "duration_s"))
    publish(clips.filter("clip_no % 3 = 0"), path, "class_name")
    publish(clips.filter("clip_no % 3 = 1"), path, "class_name")
    publish(clips.filter("class_name = 'BUILDING'").withColumn("duration_s", F.col("duration_s") * 2), path, "class_name", replace=True)
    drop_parts(v.spark, path, ["MACHINERY", "none"])
    every = reduce(DataFrame.unionByName, (read_version(v.spark, path, n).withColumn("version", F.lit(n)) for n in (1, 2, 3, 4)))
    return every.groupBy("version", "class_name").agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 3).alias("seconds"), F.min("clip_no").alias("first_clip"))
