"""A training corpus from `documents`: filter, near-duplicate removal, decontamination, redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.  A row counts by its id and text: null ids and ids that
stand twice are decided on like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm.decontaminate import find_leaks
from auralake.llm.jaccard_join import jaccard_components
from auralake.llm.packing import pack
from auralake.llm.pii import redact
from auralake.llm.quality import score_documents
from auralake.llm.queries import tokenizer_path
from auralake.llm.storage import TEXT_BATCH, filter_by_ids, join_hot_apart, materialise, row_key

_KEY = "auralake_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_KEY, row_key("doc_id", "text"))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows of the given keys; rows are told apart by id and text, so null and repeated ids are no matter."""
    return filter_by_ids(_keyed(docs), materialise(keys.toDF(_KEY).distinct(), "dropped", TEXT_BATCH), _KEY, "left_anti").select(docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1."""
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.filter("predicted = 0").select("row_key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (null ids last); documents without words all stay.

    Of rows that repeat id and text one stays.
    """
    keyed = _keyed(docs)
    found = jaccard_components(keyed, id_col=_KEY, words=5, percent=75).filter("n_shingles > 0").toDF("key", "n_shingles", "component")
    found = materialise(found.join(keyed.select(F.col(_KEY).alias("key"), "doc_id").distinct(), "key"), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    best = materialise(found.groupBy("component").agg(F.count("*").alias("n"), F.min(rank).alias("best")).filter("n > 1"), "best")
    grouped = join_hot_apart(found, best, "component", found.count())
    left = _keyed(_without(docs, grouped.filter("key <> best.key").select("key")))
    twice = materialise(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias(_KEY)), "twice")
    if twice.isEmpty():
        return left.select(docs.columns)
    once = filter_by_ids(left, twice, _KEY, "left_anti")
    return once.unionByName(filter_by_ids(left, twice, _KEY).dropDuplicates([_KEY])).select(docs.columns)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = find_leaks(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=_KEY)
    return _without(docs, found.select("doc_id"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in windows of 4096 ids; workers that have served the stages before remember fewer words."""
    return pack(docs, tokenizer_path(), window=4096, remembered=60_000)


STAGES = [
    ("quality_qda", keep_good_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("bm25_decontamination", drop_leaked),
    ("pii_redaction", redact_personal_data),
    ("window_packing", pack_windows),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm hold the operator of each stage against a plain version, and the stages against their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name, TEXT_BATCH)
    return STAGES[-1][1](spark, docs, sf_dir)
