"""Quality scores from a regularised quadratic discriminant over document statistics.

Every text becomes a vector of transformed statistics.  Counts, sums and outer
products per class, summed over all labelled training rows, give class means and
covariances, which are shrunk towards the pooled covariance and the diagonal.
The score is the logistic of the difference of the two Gaussian log densities,
from Mahalanobis distances with Cholesky factors computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.storage import TEXT_BATCH, id_long, id_text, materialise, row_key

STATISTICS = (
    "upper", "digit", "symbol", "sentence_marks", "shouting", "bars", "spaces",
    "log_word_length", "distinct_words", "repeated_lines", "capital_words", "echoed_words",
)
#: What a text is mixed with before shares are taken, so that a few bytes don't make an outlier:
#: bytes with these shares of the seven character classes, and as many words and lines.
PRIOR_BYTES, PRIOR_SHARES, PRIOR_WORDS, PRIOR_LINES = 120, (0.03, 0, 0, 0.03, 0, 0, 0.16), 20, 4
_CLASS = np.zeros((256, 7))
_CLASS[range(0x41, 0x5B), 0] = 1
_CLASS[range(0x30, 0x3A), 1] = 1
_CLASS[[*b"#$%&*@^~<>{}[]\\/=+_"], 2] = 1
_CLASS[[*b".,;:?'\""], 3] = 1
_CLASS[[*b"!"], 4] = 1
_CLASS[[*b"|\t"], 5] = 1
_CLASS[[*b" \n\r"], 6] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, transformed to be closer to normal; a null text counts as empty."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, w = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.sqrt((counts @ _CLASS + PRIOR_BYTES * np.array(PRIOR_SHARES)) / (n + PRIOR_BYTES))
    most = Counter(lines).most_common(1)[0][1] if lines else 1
    capital = sum(map(bytes.isupper, words))
    return [
        *shares.tolist(),
        math.log((sum(map(len, words)) + 5.5 * PRIOR_WORDS) / (w + PRIOR_WORDS)),
        math.sqrt((len(set(words)) + PRIOR_WORDS) / (w + PRIOR_WORDS)),
        math.sqrt((most - 1) / (len(lines) + PRIOR_LINES)),
        math.sqrt(capital / (w + PRIOR_WORDS)),
        math.sqrt(sum(map(bytes.__eq__, words, words[1:])) / (w + PRIOR_WORDS)),
    ]


@dataclass
class QuadraticDiscriminant:
    """Means, inverted Cholesky factors of the shrunk covariances and log determinants, for classes 0 and 1; factored once, when fitted."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse_factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    @staticmethod
    def fit(n: np.ndarray, sums: np.ndarray, outer: np.ndarray, to_pooled: float, to_diagonal: float) -> QuadraticDiscriminant:
        """From counts (2), sums (2, d) and outer-product sums (2, d, d).

        Without rows of both classes the score is the share of class 1 (0.5 without any).
        """
        d = sums.shape[1]
        total = max(n.sum(), 1.0)
        centre = sums.sum(axis=0) / total
        variance = np.diagonal(outer.sum(axis=0)) / total - centre**2
        scale = np.sqrt(np.maximum(variance, 1e-6))
        means, covs = np.zeros((2, d)), np.zeros((2, d, d))
        for k in (0, 1):
            if n[k]:
                m = sums[k] / n[k]
                means[k] = (m - centre) / scale
                covs[k] = (outer[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        pooled = (n[:, None, None] * covs).sum(axis=0) / total
        priors = np.log((n + 1.0) / (n.sum() + 2.0))
        if not n.all():
            return QuadraticDiscriminant(centre, scale, np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), priors)
        factors = []
        for k in (0, 1):
            c = (1 - to_pooled) * covs[k] + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diagonal(c)) + 1e-3 * np.eye(d)
            factors.append(np.linalg.cholesky(c))
        dets = np.array([2 * np.log(np.diagonal(f)).sum() for f in factors])
        return QuadraticDiscriminant(centre, scale, means, np.linalg.inv(np.stack(factors)), dets, priors)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        dense = []
        for k in (0, 1):
            y = (z - self.means[k]) @ self.inverse_factors[k].T
            dense.append(self.log_priors[k] - 0.5 * (self.log_dets[k] + (y**2).sum(axis=1)))
        # divided by the square root of the dimensions: the statistics overlap in what they tell
        return 1 / (1 + np.exp(-np.clip((dense[1] - dense[0]) / math.sqrt(x.shape[1]), -500, 500)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, x) for every row of docs; row_key is a hash of id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_key": pdf["row_key"], "x": [statistics(t) for t in pdf["text"]]})

    rows = docs.select(id_text(id_col), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return id_long(rows.mapInPandas(run, "doc_id string, row_key long, x array<double>"))


def train(stats: DataFrame, labels: DataFrame, label_col: str, to_pooled: float = 0.2, to_diagonal: float = 0.1) -> QuadraticDiscriminant:
    """Fit on every row of labels (doc_id, label_col) whose label is 0 or 1; sums per task, added up by Spark."""
    d = len(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, d)
            for k in (0, 1):
                own = x[pdf["y"].to_numpy() == k]
                total[k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        at = np.arange(total.shape[1])
        yield pd.DataFrame({"k": np.repeat([0, 1], len(at)), "i": np.tile(at, 2), "v": total.ravel()})

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = stats.join(known.filter("y IN (0, 1) AND doc_id IS NOT NULL"), "doc_id").select("x", "y")
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInPandas(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        sums[r["k"], r["i"]] = r["v"]
    return QuadraticDiscriminant.fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d), to_pooled, to_diagonal)


def score_statistics(stats: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_key": pdf["row_key"], "score": model.score(x)})

    return id_long(stats.withColumn("doc_id", id_text("doc_id")).mapInPandas(run, "doc_id string, row_key long, score double"))


def held_out(id_col: str = "doc_id"):
    """True for the fold that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3
) -> DataFrame:
    """(doc_id, row_key, held_out, score, predicted) for every row of docs.

    Learns from the labelled rows outside the held-out fold; only the text goes
    into a score.  Null and empty texts have the statistics of an empty text;
    rows that repeat an id are scored each by itself (row_key, a hash of id and
    text, tells them apart); a null id is scored and
    counts as not held out; null labels teach nothing; an empty table gives no
    rows.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics", TEXT_BATCH)
    model = train(stats, labels.filter(~held_out("doc_id")), label_col)
    scored = score_statistics(stats, model)
    return scored.select(
        "doc_id", "row_key", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
