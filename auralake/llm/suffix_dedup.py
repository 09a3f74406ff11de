"""Substring dedup with a sparse suffix array over words.

Suffixes are retained at minimiser positions only: the smallest hash of five
words in every window of W positions.  A repeated passage of M words holds, in
its first W positions, a retained position with at least R = M - W + 1 words to
its right, so the suffixes that can matter are those whose first R words occur
twice.  These are sorted by content over the cluster (range partitions, each
sorted), neighbours are compared, and the match is extended to the right and, from
the retained position, to the left.  A match of M words or more is claimed.  Two
suffixes with the same first R words are neighbours; where there are more, partners
need not be, so there the M-word windows around the retained positions are hashed
and each that occurs twice is claimed as well.  The claims of a document are united,
which restores maximal passages longer than the compared context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.llm.hashing import U64, gram_hashes, mix, word_bounds, word_hashes
from auralake.llm.storage import TEXT_BATCH, discard, filter_by_ids, join_hot_apart, materialise

GRAM = 5


def _words(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8")
    return word_hashes(raw, *word_bounds(raw))


def anchors(words: np.ndarray, window: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Retained positions with at least `right` words from there on, and the hash of those words."""
    grams = gram_hashes(words, GRAM)
    if len(words) < right or len(grams) < window:
        at = np.flatnonzero(grams == grams.min())[:1] if len(grams) else np.empty(0, dtype=np.int64)
    else:
        order = mix(grams ^ U64(0x2545F4914F6CDD1D))
        parts = []
        for first in range(0, len(order) - window + 1, 1 << 16):
            view = np.lib.stride_tricks.sliding_window_view(order[first : first + (1 << 16) + window - 1], window)
            parts.append(first + np.arange(len(view)) + view.argmin(axis=1))
        at = np.unique(np.concatenate(parts))
    at = at[at + right <= len(words)]
    return at, gram_hashes(words, right)[at] if len(at) else np.empty(0, dtype=U64)


def _anchor_rows(texts: DataFrame, window: int, right: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [anchors(_words(text), window, right)[1] for text in pdf["text"]]
            count = [len(k) for k in keys]
            yield pd.DataFrame(
                {
                    "key": np.concatenate([np.empty(0, U64), *keys]).view(np.int64),
                    "doc_id": np.repeat(pdf["doc_id"].to_numpy(), count),
                    "text_key": np.repeat(pdf["text_key"].to_numpy(), count),
                }
            )

    return texts.mapInPandas(run, "key long, doc_id long, text_key long")


_SUFFIX = "key long, after binary, before binary, doc_id long, text_key long, at long, n_after int, n_before int"


def _suffix_rows(texts: DataFrame, window: int, right: int, context: int) -> DataFrame:
    """The retained suffixes whose key is in `keys`, with `context` words beyond the key and before the position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = np.arange(context)
        for pdf in batches:
            rows = []
            for doc_id, text_key, text, wanted in zip(pdf["doc_id"], pdf["text_key"], pdf["text"], pdf["keys"], strict=True):
                words = _words(text)
                at, key = anchors(words, window, right)
                signed = key.view(np.int64)
                chosen = np.isin(signed, np.asarray(wanted))
                at, signed = at[chosen], signed[chosen]
                short = (words >> U64(32)).astype(">u4")
                padded = np.concatenate((np.zeros(context, ">u4"), short, np.zeros(context, ">u4")))
                after = padded[at[:, None] + context + right + steps]
                before = padded[at[:, None] + context - 1 - steps]
                n_after = np.minimum(context, len(words) - at - right)
                n_before = np.minimum(context, at)
                rows += zip(
                    signed.tolist(), map(bytes, after), map(bytes, before), [doc_id] * len(at), [text_key] * len(at),
                    at.tolist(), n_after.tolist(), n_before.tolist(), strict=True,
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SUFFIX.split(", ")])

    return texts.mapInPandas(run, _SUFFIX)


def _window_rows(texts: DataFrame, window: int, right: int, min_words: int) -> DataFrame:
    """The hash of every window of min_words words that has one of the keys in `many` from one of its first positions on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = np.arange(window)
        for pdf in batches:
            starts, hashes = [np.empty(0, np.int64)], [np.empty(0, U64)]
            for text, many in zip(pdf["text"], pdf["many"], strict=True):
                words = _words(text)
                at, key = anchors(words, window, right)
                at = at[np.isin(key.view(np.int64), np.asarray(many))]
                start = np.unique(at[:, None] - steps)
                start = start[(start >= 0) & (start + min_words <= len(words))]
                starts.append(start)
                hashes.append(gram_hashes(words, min_words)[start])
            count = [len(x) for x in starts[1:]]
            yield pd.DataFrame(
                {
                    "words": np.concatenate(hashes).view(np.int64),
                    "doc_id": np.repeat(pdf["doc_id"].to_numpy(), count),
                    "text_key": np.repeat(pdf["text_key"].to_numpy(), count),
                    "start": np.concatenate(starts),
                }
            )

    return texts.mapInPandas(run, "words long, doc_id long, text_key long, start long")


def _window_claims(windows: DataFrame, min_words: int) -> DataFrame:
    """A claim for each of the materialised windows that occurs twice; occurrences are counted before they are joined."""
    place = F.struct("doc_id", "text_key", "start")
    counted = windows.groupBy("words").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = join_hot_apart(windows, materialise(counted.filter("first <> last"), "repeated"), "words", windows.count())
    later = place != F.col("first")
    return repeated.select(
        "doc_id",
        "text_key",
        "start",
        (F.col("start") + min_words).alias("stop"),
        F.when(later, F.col("first.doc_id")).otherwise(F.col("last.doc_id")).alias("other_doc_id"),
        later.alias("later"),
    )


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


_CLAIM = "claim boolean, start long, stop long, other_doc_id long, later boolean"


def _compare_sorted(min_words: int, right: int, context: int):
    """Function for mapInPandas over a sorted partition: claims per suffix, and the partition's first and last suffix."""
    names = [c.split()[0] for c in (_SUFFIX + ", " + _CLAIM).split(", ")]

    def claims(pdf: pd.DataFrame) -> pd.DataFrame:
        def table(name):
            return np.frombuffer(b"".join(pdf[name]), dtype=np.uint32).reshape(len(pdf), context)

        after, before = table("after"), table("before")
        n_after, n_before = pdf["n_after"].to_numpy(), pdf["n_before"].to_numpy()
        key, doc, text, at = (pdf[c].to_numpy() for c in ("key", "doc_id", "text_key", "at"))
        r = right + np.minimum(_common(after[1:], after[:-1]), np.minimum(n_after[1:], n_after[:-1]))
        left = np.minimum(_common(before[1:], before[:-1]), np.minimum(n_before[1:], n_before[:-1]))
        itself = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (at[1:] == at[:-1])  # a row that stands twice
        hit = np.flatnonzero((key[1:] == key[:-1]) & (r + left >= min_words) & ~itself)
        own, other = np.concatenate((hit, hit + 1)), np.concatenate((hit + 1, hit))
        size_l, size_r = np.tile(left[hit], 2), np.tile(r[hit], 2)
        behind = (text[other] < text[own]) | ((text[other] == text[own]) & (at[other] < at[own]))
        later = (doc[other] < doc[own]) | ((doc[other] == doc[own]) & behind)
        return pd.DataFrame(
            {"doc_id": doc[own], "text_key": text[own], "claim": True, "start": at[own] - size_l, "stop": at[own] + size_r, "other_doc_id": doc[other], "later": later}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            if held is None:
                yield pdf.iloc[:1].assign(claim=False).reindex(columns=names)
            joined = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            yield claims(joined).reindex(columns=names)
            held = pdf.iloc[-1:]
        if held is not None:
            yield held.assign(claim=False).reindex(columns=names)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(doc_id, text_key, start_word, end_word, other_doc_id, removable): passages of min_words words or more that occur elsewhere.

    Words are runs without ASCII white space, case counts.  Overlapping claims
    of a text are united; other_doc_id is one document (possibly the same) that
    holds a part of the passage; removable says that all of it occurs earlier by
    (document, text_key, position).  Claims of first and of later occurrences
    are united apart, so removing all removable passages keeps the first
    occurrence of each.  Equal texts are found by digest and only their first is
    sorted.  Texts with fewer words, null texts and rows with a null id are left
    out; different texts of one id are told apart by text_key, a hash of the
    text; rows that repeat id and text are one text; an empty table gives no
    rows.
    """
    window = min_words // 2
    right = min_words - window + 1
    context = window - 1
    text_id = ["doc_id", "text_key"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    size = F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
    digests = materialise(rows.select(*text_id, F.unhex(F.md5("text")).alias("digest"), size.cast("long").alias("words")), "digests")
    first = materialise(digests.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "first")
    copies = join_hot_apart(digests, first, "digest", digests.count()).filter("doc_id <> first").select(*text_id, "first", "words")
    copies = materialise(copies.distinct(), "copies")
    discard(digests)
    texts = filter_by_ids(rows, copies.select(*text_id), text_id, "left_anti")

    keyed = materialise(_anchor_rows(texts, window, right), "anchors", TEXT_BATCH)
    shared = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    repeated = join_hot_apart(keyed, shared.withColumn("many", F.col("n") > 2), "key", keyed.count())
    wanted = materialise(
        repeated.groupBy(*text_id).agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("many"), F.col("key"))).alias("many")),
        "wanted",
    )  # a text's keys are bounded by its words
    discard(keyed)
    chosen = filter_by_ids(texts, wanted.select(*text_id), text_id).join(wanted, text_id)
    suffixes = materialise(_suffix_rows(chosen, window, right, context), "suffixes", TEXT_BATCH)
    order = ["key", "after", "before", *text_id, "at"]
    compare = _compare_sorted(min_words, right, context)
    schema = _SUFFIX + ", " + _CLAIM
    compared = materialise(
        suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(compare, schema), "compared"
    )
    discard(suffixes)
    # two suffixes of each partition: their number depends on the partitions alone
    edges = compared.filter("NOT claim").select(*(c.split()[0] for c in _SUFFIX.split(", ")))
    edges = edges.coalesce(1).sortWithinPartitions(*order).mapInPandas(compare, schema)
    claims = compared.filter("claim").unionByName(edges.filter("claim")).select(*text_id, "start", "stop", "other_doc_id", "later")
    windows = materialise(_window_rows(chosen.filter("size(many) > 0"), window, right, min_words), "windows", TEXT_BATCH)
    claims = claims.unionByName(_window_claims(windows, min_words))
    whole = copies.filter(F.col("words") >= min_words).select(
        *text_id, F.lit(0).cast("long").alias("start"), F.col("words").alias("stop"), F.col("first").alias("other_doc_id"), F.lit(True).alias("later")
    )
    originals = whole.groupBy(F.col("other_doc_id").alias("doc_id"), "text_key").agg(
        F.lit(0).cast("long").alias("start"), F.max("stop").alias("stop"), F.min("doc_id").alias("other_doc_id"), F.lit(False).alias("later")
    )
    return _united(claims.unionByName(whole).unionByName(originals))


def _united(claims: DataFrame) -> DataFrame:
    """Overlapping claims of a text as one passage each, those of first and of later occurrences apart."""
    w = Window.partitionBy("doc_id", "text_key", "later").orderBy("start", "stop")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = claims.withColumn("fresh", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int"))
    numbered = marked.withColumn("passage", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("doc_id", "text_key", "later", "passage")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other_doc_id").alias("other_doc_id"))
        .select("doc_id", "text_key", "start_word", "end_word", "other_doc_id", F.col("later").alias("removable"))
    )
