"""Brute-force versions of the periodic runs, the exact top-k search and the whitening."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import topk_search
from auralake.llm.periodic_runs import periodic_runs, with_planted_runs, word_runs
from auralake.llm.queries import op11_periodic_runs, op12_exact_top_k, op13_whitening
from auralake.llm.topk_search import SortedLists, exact_top_k, qualified
from auralake.llm.whitening import one_sided_jacobi, pivoted_cholesky, principal_components, whiten

DATA = "/root/testdata/sf0.001"
LARGE = 2**60


# ---- op11 --------------------------------------------------------------------------------------


def plain_runs(w, times=4, shortest=6):
    """Every lag at every position; a stretch counts with its smallest period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize(("times", "shortest"), [(4, 6), (3, 5), (5, 1)])
def test_word_runs_equal_every_lag(times, shortest):
    rng = random.Random(times)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            w = [rng.randrange(rng.choice((1, 2, 3, 5, 50))) for _ in range(rng.randrange(40))]
            for _ in range(rng.randrange(3)):
                block = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
                at = rng.randrange(len(w) + 1)
                w[at:at] = (block * 9)[: rng.randrange(len(block) * 3, len(block) * 9)]
            docs.append(w)
        found = word_runs(np.array(sum(docs, []), dtype=np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), times, shortest)
        first = 0
        for i, d in enumerate(docs):
            assert [(s - first, n, q) for s, n, q in found.get(i, [])] == plain_runs(d, times, shortest)
            first += len(d)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op11_periodic_runs(spark, DATA).collect())) == sorted(plain_row(*d) for d in docs)


def test_periodic_runs_of_awkward_rows(spark, awkward, empty):
    planted = with_planted_runs(awkward)
    assert planted.columns == awkward.columns
    rows = {(r["doc_id"], r["n_words"], r["collapsed"]) for r in periodic_runs(awkward).collect()}
    body = " ".join(f"word{i}" for i in range(60))
    assert {(1, 60, body), (None, 60, body), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 2, "two words"), (7, 40_001, "long end")} <= rows
    assert periodic_runs(awkward).count() == awkward.count()
    assert periodic_runs(empty).collect() == [] and with_planted_runs(empty).collect() == []


def test_periodic_runs_keep_large_ids_beside_nulls(spark):
    rows = spark.createDataFrame([(LARGE + 1, "a b"), (None, "c"), (LARGE, "d")], "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["collapsed"]) for r in periodic_runs(rows).collect()} == {(LARGE + 1, "a b"), (None, "c"), (LARGE, "d")}


def test_a_long_text_is_scanned_whole(spark):
    words = [f"w{i % 7001}" for i in range(300_000)]
    text = " ".join(["x", *words, "y"])
    (row,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(1, 300_000, 7001)]
    assert row["collapsed"] == " ".join(["x", *words[:7001], "y"])


# ---- op12 --------------------------------------------------------------------------------------


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain_top_k(rows, k=10, scale=1024):
    whole = [(i, [math.floor(scale * c) for c in v], n) for n, (i, v) in enumerate(rows) if usable(v)]
    out = []
    for i, v, n in whole:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, x, strict=True)), j) for j, x, m in whole if m != n and len(x) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def test_top_k_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op12_exact_top_k(spark, DATA).collect()), key=str) == plain_top_k(rows)


AWKWARD_VECTORS = [
    (0, [1.0, -2.0, 0.5]), (100, [1.0, -2.0, 0.5]), (100, [0.0, 0.0, 0.0]), (1, [1.0, -2.0, 0.5]), (2, [1.0, -2.0, 0.5]), (2, [1.0, -2.0, 0.5]),
    (None, [1.0, -2.0, 0.5]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [1.0, float("inf"), 2.0]), (7, []), (200, []),
    (8, [1.0, 2.0]), (300, [3.0, 1.0]), (LARGE + 1, [5.0, 5.0, 5.0]), (LARGE, [5.0, 5.0, 5.0]), (400, None), (500, [float("-inf"), 0.0, 0.0]),
]
CLASHING = "vec_id long, embedding array<double>, row string, x int, score string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", "c") for r in rows], CLASHING)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_k_of_awkward_vectors(spark, k):
    found = exact_top_k(vectors(spark, AWKWARD_VECTORS), F.col("vec_id") % 100 == 0, k=k)
    assert sorted(map(tuple, found.collect()), key=str) == plain_top_k(AWKWARD_VECTORS, k)
    assert exact_top_k(vectors(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert exact_top_k(vectors(spark, AWKWARD_VECTORS[3:5]), F.col("vec_id") % 100 == 0).collect() == []


def test_top_k_over_many_blocks_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "ROUND_VALUES", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] * (i % 3) + rng.normal(size=12)).round(2).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[0][1]) for i in range(200)]  # one vector many times
    found = exact_top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=10)
    assert sorted(map(tuple, found.collect()), key=str) == plain_top_k(rows)


def test_reading_stops_before_the_ends_of_the_lists():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4096, 16)) * 100).astype(np.int64)
    q = np.floor(rng.normal(size=(20, 16)) * 100).astype(np.int64)
    scores = q @ x.T
    known = -np.sort(-scores, axis=1)[:, 9].astype(float)
    none = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    for bound in (known, np.full(20, -np.inf)):
        sizes = []
        for i, able in qualified(SortedLists(x), q, none, bound, 10):
            assert set(np.flatnonzero(scores[i] >= known[i])) <= set(able)
            sizes.append(len(able))
        assert len(sizes) == 20 and np.mean(sizes) < 400


# ---- op13 --------------------------------------------------------------------------------------


def plain_whitening(rows, components=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    y = (x - s / n)
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in x]
    return n, deviation, y @ vecs[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(found, rows, components=32):
    n, deviation, white, share = plain_whitening(rows, components)
    by_id = defaultdict(dict)
    for r in found:
        by_id[r["vec_id"]][r["component"]] = r
    assert len(found) == len(rows) * len(share)
    for c in range(len(share)):
        mine = np.array([by_id[i][c + 1]["whitened"] for i, _ in rows])
        assert min(np.abs(mine - white[:, c]).max(), np.abs(mine + white[:, c]).max()) < 1e-6
        for (i, _), d in zip(rows, deviation, strict=True):
            r = by_id[i][c + 1]
            assert (r["n"], r["deviation"]) == (n, d)
            assert abs(r["explained"] / share[c] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_whitening_query_equals_an_eigensolver(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(op13_whitening(spark, DATA).collect(), rows)


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=5) * [1, 2, 3, 4, 0]).tolist()) for i in range(40)] + [(LARGE + 1, [1.0, 2.0, 3.0, 4.0, 0.0]), (None, [0.0] * 5), (LARGE, [0.5] * 4 + [0.0])]
    bad = [(900, None), (901, [None] * 5), (902, [float("nan")] * 5), (903, [1.0, 2.0]), (904, []), (905, [float("inf")] * 5)]
    found = whiten(vectors(spark, bad[:3] + good + bad[3:]).coalesce(1), components=3).collect()
    check_whitening(found, good, 3)
    assert len(whiten(vectors(spark, good)).first()) == 7
    for rows in ([], bad[:1], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whiten(vectors(spark, rows)).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(1, [2.0**40]), (2, [-(2.0**40)]), (3, [0.0])]
    found = {r["vec_id"]: r["deviation"] for r in whiten(vectors(spark, rows)).collect()}
    assert found == {1: None, 2: None, 3: 0}


@pytest.mark.parametrize(("d", "n"), [(64, 500), (5, 100), (40, 12), (1, 9)])
def test_components_of_a_scatter(d, n):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 30, size=d)
    y = x - x.mean(axis=0)
    a = y.T @ y
    g = pivoted_cholesky(a)
    assert np.abs(g @ g.T - a).max() < 1e-12 * np.abs(a).max()
    rotated = one_sided_jacobi(g)
    gram = rotated.T @ rotated
    assert np.abs(gram - np.diag(np.diagonal(gram))).max() < 1e-12 * gram.max()
    values, vecs = principal_components(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], rtol=1e-9)
    assert np.abs(vecs.T @ vecs - np.eye(len(values))).max() < 1e-12 and np.abs(a @ vecs - vecs * values).max() < 1e-12 * values[0]
