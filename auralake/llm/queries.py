"""The operators as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm import decontaminate, jaccard_join, line_dedup, media, packing, periodic_runs, pii, quality, sharding, suffix_dedup, tool_calls, topk_search, whitening


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"), min_words=50).drop("text_key")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row_key")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(_table(spark, sf_dir, "documents"), min_words=30).drop("text_key")


def op5_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def op6_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), window=4096)


def op7_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations")
    return tool_calls.link_tool_calls(tool_calls.derive_calls(talk), tool_calls.derive_results(talk), tool_calls.SCHEMAS)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), words=5, percent=75)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periodic_runs.longest_run(F.col("runs"))
    return (
        periodic_runs.periodic_runs(docs)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            "best.start",
            "best.length",
            "best.period",
            F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
            F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array_dedup, op2_pii_spans, op3_quality_qda, op4_line_dedup, op5_slot_shards, op6_window_packing,
        op7_jpeg_media, op8_bm25_decontamination, op9_tool_call_linking, op10_ngram_jaccard_join, op11_periodic_runs, op12_exact_top_k, op13_whitening,
    )
    return {f.__name__: f for f in found}


_LINE_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '(?s).*?(?:[.!?,;:]+[ \t-\r]|\n|$)') AS parts
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), pieces AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut
), placed AS (
  SELECT doc_id, i, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS "end",
         trim(regexp_replace(lower(part), '[ \t\n\v\f\r]+', ' ', 'g')) AS n
  FROM pieces
), units AS (
  SELECT doc_id, "end" - length(part) AS start, "end", n, len(string_split(n, ' ')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit
  FROM placed WHERE n <> ''
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY n) AS times,
         first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
  FROM units WINDOW w AS (PARTITION BY n ORDER BY doc_id, start)
), chained AS (
  SELECT *, doc_id <> kept_doc_id OR start <> kept_start AS removed,
         unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS chain
  FROM ranked WHERE times > 1
), passages AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id, chain) AS total FROM chained
), runs AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, removed ORDER BY unit) AS run FROM passages WHERE total >= 30
)
SELECT doc_id, min(start) AS start, max("end") AS "end", CAST(sum(words) AS BIGINT) AS words, removed,
       arg_min(kept_doc_id, unit) AS kept_doc_id, arg_min(kept_start, unit) AS kept_start
FROM runs GROUP BY doc_id, chain, removed, run
"""

_TOOL_CALLS = """
WITH RECURSIVE spoken AS (
  SELECT conv_id, turn, text, length(coalesce(text, '')) AS n, to_json(coalesce(text, '')) AS q
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), calls AS (
  SELECT conv_id, 'call_' || turn AS call_id, turn,
    CASE n % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'measure' ELSE 'note' END AS tool,
    CASE n % 3
      WHEN 0 THEN '{"limit":' || CASE WHEN n % 7 = 0 THEN '"5"' ELSE '5' END || ',"query":' || q || '}'
      WHEN 1 THEN '{"exact":true' || CASE WHEN n % 5 = 0 THEN '' ELSE ',"length":' || n END || '}'
      ELSE '{' || CASE WHEN n % 4 = 0 THEN '' ELSE '"tags":[1,2],' END || '"text":' || q || '}' END AS canonical,
    CASE WHEN n % 3 = 0 AND n % 7 = 0 THEN 'limit: not integer'
         WHEN n % 3 = 1 AND n % 5 = 0 THEN 'length: missing'
         WHEN n % 3 = 2 AND n % 4 = 0 THEN 'tags: missing' ELSE '' END AS errors,
    CASE WHEN turn > 0 THEN 'call_' || (turn // 2) END AS parent_id
  FROM spoken
), results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, turn, text AS content
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), levels AS (
  SELECT conv_id, call_id, 0 AS level FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.call_id = c.parent_id)
  UNION ALL
  SELECT c.conv_id, c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.conv_id = l.conv_id AND c.parent_id = l.call_id
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'pending'
       WHEN r.turn < c.turn THEN 'early' ELSE 'linked' END AS status,
  CAST(l.level AS INTEGER) AS level, coalesce(c.errors = '', false) AS valid, coalesce(c.errors, '') AS errors,
  '{"arguments":' || coalesce(c.canonical, 'null') || ',"call_id":' || to_json(coalesce(c.call_id, r.call_id)) ||
  ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || ',"tool":' || coalesce(CAST(to_json(c.tool) AS VARCHAR), 'null') || '}' AS record
FROM calls c FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id
"""

_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS other FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), components AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN components c ON c.doc_id = w.doc_id
"""


_TOP_K = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _LINE_DEDUP, "op9_tool_call_linking": _TOOL_CALLS, "op10_ngram_jaccard_join": _JACCARD, "op12_exact_top_k": _TOP_K}
