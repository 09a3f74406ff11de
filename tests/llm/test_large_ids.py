"""Ids beyond 2**53 beside a null id in one batch, and other nullable columns, stay what they are."""

import datetime
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import decontaminate, jaccard_join, media, packing, pii, quality
from auralake.llm.queries import tokenizer_path

LARGE = 2**60
IDS = [LARGE + 1, None, LARGE]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n))


@pytest.fixture
def docs(spark):
    rows = [(i, prose(n) + f" mail{n}@example.org") for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def ids(frame):
    return sorted((r["doc_id"] for r in frame.collect()), key=str)


EXPECTED = sorted(IDS, key=str)


def test_spans_media_pieces_and_scores(spark, docs):
    labels = spark.createDataFrame([(LARGE, 1), (LARGE + 1, 0)], "doc_id long, quality int")
    spans = pii.find_spans(docs)
    assert ids(spans) == EXPECTED and {r["doc_id"]: r["n_email"] for r in spans.collect()} == dict.fromkeys(IDS, 1)
    made = media.media_columns(docs, keep_media=True)
    assert ids(made) == EXPECTED and ids(media.thumbnails(made)) == EXPECTED
    assert ids(packing.pack(docs, tokenizer_path(), window=4096)) == EXPECTED
    assert ids(packing.pack(docs.repartition(3), tokenizer_path(), window=64).select("doc_id").distinct()) == EXPECTED
    assert ids(quality.score_documents(docs, labels)) == EXPECTED
    for frame in (spans, made, packing.pack(docs, tokenizer_path()), quality.score_documents(docs, labels)):
        assert dict(frame.dtypes)["doc_id"] == "bigint"


def test_leaks(spark, docs):
    items = spark.createDataFrame([(LARGE + 5, prose(0)), (LARGE + 4, prose(2)), (None, prose(1))], "item_id long, text string").coalesce(1)
    found = decontaminate.find_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(LARGE + 1, LARGE + 5), (LARGE, LARGE + 4)}
    assert dict(found.dtypes)["doc_id"] == "bigint"


def test_components(spark, docs):
    copy = spark.createDataFrame([(LARGE + 7, prose(0) + " mail0@example.org")], "doc_id long, text string")
    rows = jaccard_join.jaccard_components(docs.unionByName(copy).coalesce(1)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(LARGE + 1, LARGE + 1), (LARGE + 7, LARGE + 1), (LARGE, LARGE), (None, None)}


def test_redaction_leaves_other_columns(spark):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [
        (LARGE + 1, "a b@c.org", LARGE + 3, 3, True, Decimal("12345678901234567.89"), when, [LARGE + 1, None], {"k": None}, b"\0\xff", 0.1),
        (None, None, None, None, None, None, None, None, None, None, None),
        (LARGE, "x", LARGE + 2, None, False, Decimal("0.01"), None, [], {"k": LARGE + 9}, b"", float("nan")),
    ]
    schema = "doc_id long, text string, n long, i int, b boolean, d decimal(20,2), t timestamp, a array<long>, m map<string,long>, raw binary, x double"
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    done = pii.redact(docs)
    assert done.schema == docs.schema
    others = [c for c in docs.columns if c != "text"]
    as_text = lambda f: sorted(map(str, f.select(*others).collect()))
    assert as_text(done) == as_text(docs)
    assert {r["text"] for r in done.collect()} == {"a [EMAIL]", None, "x"}


@pytest.mark.parametrize("threshold", [0.05, 0.1, 0.2, 0.3, 0.5, 0.9])
def test_search_equals_full_scores(threshold):
    """Items of frequent words only, asked with passages that hold no rare word at all."""
    rng = np.random.default_rng(8)
    common = np.sort(rng.choice(2**62, 25, replace=False))
    rare = np.sort(rng.choice(2**62, 200, replace=False))
    items = []
    for i in range(60):
        own = np.sort(np.concatenate((rng.choice(common, 14, replace=False), rng.choice(rare, 3, replace=False))))
        weight = np.where(np.isin(own, common), 0.2 * rng.random(len(own)) + 0.1, 4.0)
        items.append({"item_id": i, "length": 20, "terms": own.tolist(), "weights": (weight / weight.sum()).tolist(), "question": [], "answer": []})
    index = decontaminate.ItemIndex(items, 64)
    reached = 0
    for n in range(40):
        words = rng.choice(common, 20).astype(np.uint64) if n % 2 else rng.choice(np.concatenate((common, rare)), 300).astype(np.uint64)
        expected = set()
        for first in range(0, len(words), 32):
            held = set(words[first : first + 64].tolist())
            expected |= {(i, first) for i, r in enumerate(items) if sum(w for t, w in zip(r["terms"], r["weights"], strict=True) if t in held) >= threshold}
        found = {(i, first) for i, _, first in index.search(words, threshold)}
        assert found == expected
        reached += len(expected)
    assert reached or threshold > 0.5
