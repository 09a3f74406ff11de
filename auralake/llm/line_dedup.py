"""Substring dedup by hashing lines and their clauses.

A text is cut at line ends and after punctuation that white space follows, so a
passage that was set into a longer line has units of its own.  Units are
normalised (white space collapsed, lower case) and their digests grouped over
all documents.  Adjacent units that occur elsewhere too are chained; chains of
`min_words` words or more are repeated passages, so that a short phrase met by
chance is left alone.  In a passage, the earliest occurrence of each unit by
(document, text, offset) is kept and the others are removed; offsets into the
original texts are retained.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.llm.storage import TEXT_BATCH, join_hot_apart, materialise

#: Where a unit ends: punctuation with the white space after it, or a line end.
UNIT_END = "[.!?,;:]+[ \t-\r]|\n"
_END = re.compile(UNIT_END)
_UNIT = "doc_id long, text_key long, unit long, start long, end long, words long, digest binary"


def line_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, unit, start, end, words, digest) of every unit with a word; offsets are code points.

    unit numbers them from 0 in their text; text_key is a hash of the whole text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, key, text in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], strict=True):
                start = unit = 0
                for end in (*(m.end() for m in _END.finditer(text)), len(text)):
                    words = text[start:end].lower().encode().split()
                    if words:
                        digest = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
                        rows.append((doc_id, key, unit, start, end, len(words), digest))
                        unit += 1
                    start = end
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _UNIT.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(run, _UNIT)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """(doc_id, text_key, start, end, words, removed, kept_doc_id, kept_start): the repeated passages, cut where `removed` changes.

    removed says that each unit of the run occurs earlier, its first one at
    (kept_doc_id, kept_start); other runs hold the occurrences that stay.  A unit
    is removed only where it is not the earliest, so no text is lost as a whole.

    Counts and earliest occurrences come from partial aggregation, so a line
    that a third of all documents share is combined before the shuffle; hot
    units are joined where they are.  Texts without words, null texts and rows
    with a null id are left alone; different texts of one id are told apart;
    rows that repeat id and text are the same occurrences and give equal rows,
    so the first stays whole; an empty table gives no rows.
    """
    units = materialise(line_units(docs, id_col, text_col), "units", TEXT_BATCH)
    place = F.struct("doc_id", "text_key", "start")
    first = materialise(units.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("kept")).filter("n > 1"), "first")
    found = join_hot_apart(units, first, "digest", units.count()).select(
        "doc_id", "text_key", "unit", "start", "end", "words", (place != F.col("kept")).alias("removed"), F.struct("kept.doc_id", "kept.start").alias("kept")
    )
    # a text's units meet in one task from here on; all steps keep that partitioning
    text = ["doc_id", "text_key"]
    rank = F.dense_rank().over(Window.partitionBy(*text).orderBy("unit"))
    chained = found.withColumn("chain", F.col("unit") - rank)
    whole = Window.partitionBy(*text, "chain")
    times = F.count("*").over(whole) / (F.max("unit").over(whole) - F.min("unit").over(whole) + 1)
    long_ones = chained.withColumn("total", F.sum("words").over(whole) / times).filter(F.col("total") >= min_words)
    flagged = long_ones.withColumn("run", F.col("unit") - F.dense_rank().over(Window.partitionBy(*text, "removed").orderBy("unit")))
    once = F.count("*") / (F.max("unit") - F.min("unit") + 1)
    return (
        flagged.groupBy(*text, "chain", "removed", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.sum("words") / once).cast("long").alias("words"),
            F.min_by("kept", "unit").alias("kept"),
        )
        .select(*text, "start", "end", "words", "removed", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """docs with the removed runs cut out of the text, and removed: their [start, end) offsets in the original.

    A column named removed is replaced.  Other rows of an id keep what is
    repeated in this one only.
    """
    spans = (
        repeated_runs(docs, id_col, text_col, min_words)
        .filter("removed")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))  # bounded by the runs of one text
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))
    )
    plain = docs.drop("removed")
    joined = plain.join(spans, (plain[id_col].cast("long") == spans["_id"]) & (F.xxhash64(plain[text_col]) == spans["_key"]), "left")
    kept = F.aggregate(
        "removed",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            x["end"].alias("at"),
            F.concat(s["out"], F.substring(F.col(text_col), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text_col), (s["at"] + 1).cast("int"), F.length(text_col))),
    )
    text = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(kept)
    return joined.withColumn(text_col, text).select(*plain.columns, "removed")
