import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def text(seed, n=120):
    r = random.Random(seed)
    return " ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n))


@pytest.fixture
def docs(spark):
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    leaked = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    near = text(1).split()
    rows = [
        (7, text(1)), (None, " ".join([*near[:60], "changed", *near[61:]])), (5, text(2)), (5, text(3)), (9, text(3)),
        (4, text(4)), (4, text(4)), (None, text(5)), (None, text(5)), (None, text(6) + " " + leaked), (8, text(7)), (8, leaked + " " + text(8)),
        (11, ""), (11, ""), (12, None), (None, None), (13, "long " * 30_000 + "end"),
    ]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    for c in given.columns[2:]:
        small = small.withColumn(c, small["doc_id"].cast(given.schema[c].dataType))
    return small.select(given.columns)


def kept(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_near_duplicates_of_null_and_repeated_ids(spark, docs):
    left = kept(corpus_pipeline.drop_near_duplicates(spark, docs, DATA))
    assert [i for i, t in left if t and t.split()[:20] == text(1).split()[:20]] == [7]
    assert (5, text(2)) in left and (5, text(3)) in left and (9, text(3)) not in left
    assert left.count((4, text(4))) == 1 and left.count((None, text(5))) == 1
    assert left.count((11, "")) == 2 and (12, None) in left and (None, None) in left


def test_leaks_of_null_and_repeated_ids(spark, docs):
    before, left = kept(docs), kept(corpus_pipeline.drop_leaked(spark, docs, DATA))
    gone = [r for r in before if r not in left]
    assert sorted(i is None for i, _ in gone) == [False, True] and (8, text(7)) in left and len(left) == len(before) - 2


def test_quality_decides_row_by_row(spark, docs):
    from auralake.llm.quality import score_documents

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    many = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(docs)
    scored = score_documents(many, labels).filter("predicted = 1").count()
    left = corpus_pipeline.keep_good_quality(spark, many, DATA)
    assert left.count() == scored and left.columns == many.columns


def test_stages_of_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
