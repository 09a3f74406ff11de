"""Live windows as messages: JSON lines in files, read as a stream, with a side for what can't be taken.

A message tells session, window, time, length and size of the sound, and the
second model's scores as text.  Files are the source, so offsets and batches are
Spark's own and a checkpoint replays what was not finished; every batch writes a
folder of its own on either side, so a replay writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators.dataset import admissible_window, parse_scores
from auralake.plans.registry import Views, query
from auralake.streaming.jobs import shared_folder

MESSAGE = "session_id long, window_id long, seen_us long, duration_s double, bytes long, scores string"


def message_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(value): the lines of all files below folder, of at most `files` files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", files).text(folder)


def parse_messages(lines: DataFrame) -> DataFrame:
    """(value, reason, session_id, window_id, seen_at, duration_s, bytes, gtm): gtm is dataset.parse_scores of the scores.

    reason is '' for a window that is taken; else it says why not: an empty line,
    no JSON or a field of another kind, no session, window or time, or what
    dataset.admissible_window says.  Scores that can't be read don't refuse a
    window; gtm.error tells about them.
    """
    read = F.from_json("value", f"{MESSAGE}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    m = lines.select("value", read.alias("m")).select("value", "m.*")
    reason = (
        F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty")
        .when(F.col("_bad").isNotNull(), "not a message")
        .when(F.col("session_id").isNull(), "no session")
        .when(F.col("window_id").isNull(), "no window")
        .when(F.col("seen_us").isNull(), "no time")
        .otherwise(F.coalesce(admissible_window("bytes", "duration_s"), F.lit("")))
    )
    return m.select("value", reason.alias("reason"), "session_id", "window_id", F.timestamp_micros("seen_us").alias("seen_at"), "duration_s", "bytes", parse_scores("scores").alias("gtm"))


def take_messages(spark: SparkSession, folder: str, out: str, files: int = 100) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) after reading all files that are there and were not read before; what earlier runs took is in it.

    accepted: the parsed columns; rejected: value and reason.  out holds both
    sides and the state, and is given again to go on.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = batch.persist()
        try:
            parsed.filter("reason = ''").drop("reason", "value").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
            parsed.filter("reason <> ''").select("value", "reason").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        finally:
            parsed.unpersist()

    parsed = parse_messages(message_stream(spark, folder, files))
    running = parsed.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    accepted = spark.read.schema(parsed.drop("reason", "value").schema).parquet(f"{out}/accepted/*")
    return accepted, spark.read.schema(parsed.select("value", "reason").schema).parquet(f"{out}/rejected/*")


_GOOD, _BAD = '"{\\"labels\\":[\\"a\\",\\"b\\"],\\"clip\\":[0.25,0.75]}"', '"{\\"labels\\":[\\"a\\",\\"b\\"],\\"clip\\":[0.5,0.9]}"'
_LINE = """CASE event_id % 11 WHEN 0 THEN '{"session_id":' || user_id || ', broken' WHEN 1 THEN '' WHEN 2 THEN '{"window_id":' || event_id || '}' WHEN 3 THEN '{"session_id":"x","window_id":' || event_id || ',"seen_us":1}'
    WHEN 4 THEN '{"session_id":' || user_id || ',"window_id":' || event_id || '}' WHEN 5 THEN '{"session_id":1,"seen_us":' || event_id || '}' ELSE
    '{"session_id":' || user_id || ',"window_id":' || event_id || ',"seen_us":' || event_id * 1000003 || ',"duration_s":' || CASE WHEN event_id % 11 = 6 THEN '9.5' ELSE '1.0' END || ',"bytes":' || CASE WHEN event_id % 11 = 7 THEN 0 ELSE 32000 END ||
    CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',"scores":' || GOOD WHEN 2 THEN ',"scores":' || BAD ELSE ',"scores":"none"' END || '}' END"""


@query(
    "io9_live_messages",
    f"""SELECT event_id AS window_id, user_id AS session_id, make_timestamp(event_id * 1000003) AS seen_at, CAST(CASE WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS INTEGER) AS classes,
    CASE event_id % 4 WHEN 0 THEN 'nothing was sent' WHEN 1 THEN '' WHEN 2 THEN 'not probabilities' ELSE 'not a score list' END AS score_error, NULL AS line, '' AS reason FROM events WHERE event_id % 11 > 7
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, md5({_LINE.replace("GOOD", f"'{_GOOD}'").replace("BAD", f"'{_BAD}'")}), ['not a message', 'empty', 'no session', 'not a message', 'no time', 'no window', 'length', 'size'][event_id % 11 + 1] FROM events WHERE event_id % 11 <= 7""",
)
def _io9(v: Views) -> DataFrame:
    """The given events as messages in several files, seven of eleven spoilt in some way; both sides."""
    folder = shared_folder(v.spark)
    events = v.events.withColumns({"good": F.lit(_GOOD), "bad": F.lit(_BAD)})
    lines = events.select(F.expr(_LINE.replace("GOOD", "good").replace("BAD", "bad")).alias("value"))
    lines.repartition(4).write.text(f"{folder}/in")
    accepted, rejected = take_messages(v.spark, f"{folder}/in", folder, files=2)
    taken = accepted.select("window_id", "session_id", "seen_at", F.coalesce(F.map_keys("gtm.scores"), F.array().cast("array<string>")).alias("c"), F.col("gtm.error").alias("score_error"))
    taken = taken.select("window_id", "session_id", "seen_at", F.size("c").alias("classes"), "score_error", F.lit(None).cast("string").alias("line"), F.lit("").alias("reason"))
    refused = rejected.select(F.md5("value").alias("line"), "reason")
    return taken.unionByName(refused, allowMissingColumns=True)
