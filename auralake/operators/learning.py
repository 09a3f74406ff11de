"""Classifier training on features with Spark ML, feature ranking, and the shortcut probe."""

from __future__ import annotations

import random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.operators.dataset import first_per_class, stable_order
from auralake.operators.evaluation import class_metrics, confusion
from auralake.operators.ordering import new_folder, settled
from auralake.operators.signals import recording_properties
from auralake.plans.registry import Views, query


def train_tuned(train: DataFrame, validation: DataFrame, classes: int, strengths: tuple[float, ...] = (0.001, 0.01, 0.1)) -> tuple[object, DataFrame]:
    """(best model, (strength, macro_f1) per candidate): standardised logistic regression, chosen by validation macro F1.

    train, validation: y, features (array of doubles).
    """
    vectors = lambda df: df.select(F.col("y").cast("double").alias("label"), array_to_vector("features").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(vectors(train))
    fitted, tested = scaler.transform(vectors(train)), scaler.transform(vectors(validation))
    found = []
    for s in strengths:
        path = new_folder(train.sparkSession, "models")
        LogisticRegression(regParam=s, maxIter=30).fit(fitted).write().save(path)
        model = LogisticRegressionModel.load(path)  # without its training summary, which holds the session and can't be sent to tasks
        matrix = confusion(model.transform(tested), "label", "prediction", classes)
        found.append((model, s, class_metrics(matrix).agg(F.avg("f1")).first()[0]))
    best = max(found, key=lambda x: (x[2], -x[1]))
    table = train.sparkSession.createDataFrame([(s, f) for _, s, f in found], "strength double, macro_f1 double")
    return best[0], table


def sampled_settings(trials: int, seed: int) -> list[dict]:
    """Settings of forests, drawn at random but the same for a seed: depth, least rows of a leaf, share of rows and of features a tree sees."""
    draw = random.Random(seed)
    return [
        {"depth": draw.randint(3, 12), "leaf": int(2 ** draw.uniform(0, 5)), "rows": round(draw.uniform(0.5, 1.0), 3), "features": round(draw.uniform(0.2, 1.0), 3)}
        for _ in range(trials)
    ]


def search_trees(train: DataFrame, validation: DataFrame, classes: int, trials: int = 8, trees: int = 4, most: int = 64, seed: int = 0, gain: float = 0.001) -> tuple[object, DataFrame]:
    """(best model, table of all trials): random search over forests with successive halving, judged by validation macro F1.

    train, validation: y, features (array of doubles).  All settings begin with
    `trees` trees; the better half goes on with twice as many, up to `most`.  A
    setting that gains less than `gain` by the doubling stops there, and so does
    the search when none goes on.  Both tables are settled once, as every fit reads them.
    The settings are those of the seed; the rows that a tree sees depend on the partitions, too.
    The table has a row for each fit: trial, rung, trees, the setting and macro_f1.
    """
    vectors = lambda df: settled(df.select(F.col("y").cast("double").alias("label"), "features")).select("label", array_to_vector("features").alias("features"))
    fitted, tested = vectors(train), vectors(validation)
    going, rung, best, rows = [(i, s, -1.0) for i, s in enumerate(sampled_settings(trials, seed))], 0, None, []
    while going:
        scored = []
        for i, s, before in going:
            forest = RandomForestClassifier(numTrees=trees, maxDepth=s["depth"], minInstancesPerNode=s["leaf"], subsamplingRate=s["rows"], featureSubsetStrategy=str(s["features"]), seed=seed)
            model = forest.fit(fitted).copy()  # without its summary, which holds the session
            f1 = class_metrics(confusion(model.transform(tested), "label", "prediction", classes)).agg(F.avg("f1")).first()[0]
            rows.append((i, rung, trees, s["depth"], s["leaf"], s["rows"], s["features"], f1))
            scored.append((f1, -i, s, before))
            if best is None or f1 > best[0]:
                best = (f1, model)
        scored.sort(key=lambda x: x[:2], reverse=True)
        kept = scored[: len(scored) // 2] if trees * 2 <= most else []
        going = [(-i, s, f1) for f1, i, s, before in kept if f1 - before >= gain]
        rung, trees = rung + 1, trees * 2
    schema = "trial int, rung int, trees int, depth int, leaf int, rows double, features double, macro_f1 double"
    return best[1], train.sparkSession.createDataFrame(rows, schema)


def feature_ranking(train: DataFrame, trees: int = 20) -> DataFrame:
    """(feature, importance) of a random forest, largest first."""
    model = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=7).fit(
        train.select(F.col("y").cast("double").alias("label"), array_to_vector("features").alias("features"))
    )
    rows = [(i, float(x)) for i, x in enumerate(model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(rows, "feature int, importance double").orderBy(F.desc("importance"), "feature")


def fold_of(group: str, folds: int) -> Column:
    """The fold of a group: its md5 as a number, modulo the folds."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def _cross_validated(data: DataFrame, folds: int) -> list[tuple[int, int, int]]:
    """(fold, n, correct) of a forest per fold.  data: fold, y (a number), features; settled.

    Each fold is counted right after its fit, so no plan outlives its model.
    """
    data = data.select("fold", F.col("y").cast("double").alias("label"), array_to_vector("features").alias("features"))
    out = []
    for k in range(folds):
        train = data.filter(F.col("fold") != k)
        if train.isEmpty():
            continue
        # a copy leaves out the training summary, which holds the session and can't be sent to tasks
        model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=7).fit(train).copy()
        tested = model.transform(data.filter(F.col("fold") == k))
        n, correct = tested.agg(F.count("*"), F.count_if(F.col("prediction") == F.col("label"))).first()
        out.append((k, n, correct))
    return out


def shortcut_probe(rows: DataFrame, per_class: int = 60, folds: int = 5) -> DataFrame:
    """(fold, n, correct, chance): a forest on recording-format features, cross-validated with whole groups per fold.

    rows: key, y (class number), group_id, features.  A sample of per_class rows a
    class is the feature; accuracy far above chance (one over the classes) means
    that the format gives the class away.
    """
    sample = first_per_class(rows, per_class, "y", [stable_order("0", "key"), "key"])
    classes = rows.agg(F.count_distinct("y")).first()[0]
    found = _cross_validated(settled(sample.withColumn("fold", fold_of("group_id", folds))), folds)
    chance = F.lit(1.0 / max(1, classes)).alias("chance")
    return rows.sparkSession.createDataFrame(found, "fold int, n long, correct long").select("*", chance)


def source_sample(rows: DataFrame, per_source: int = 40, least: int = 20, folds: int = 5) -> DataFrame:
    """(y, source, fold, key, features) of up to per_source clips of every source with `least` clips or more, in classes with several such sources."""
    held = rows.groupBy("y", "source").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    several = held.groupBy("y").agg(F.count("*").alias("sources")).filter("sources > 1")
    chosen = rows.join(held, ["y", "source"], "left_semi").join(several, "y", "left_semi").withColumn("both", F.struct("y", "source"))
    first = first_per_class(chosen, per_source, "both", [stable_order("0", "key"), "key"])
    return first.select("y", "source", fold_of("group_id", folds).alias("fold"), "key", "features")


def source_probe(rows: DataFrame, per_source: int = 40, least: int = 20, folds: int = 5) -> DataFrame:
    """(y, accuracy, majority) of each class: whether the format tells a clip's source among those with at least `least` clips, and the share of the largest source.

    rows: key, y, source (a number), group_id, features.  Classes with one such
    source are left out.  The loop is over classes, a short list.
    """
    sample = settled(source_sample(rows, per_source, least, folds))
    sizes = sample.groupBy("y", "source").agg(F.count("*").alias("n")).groupBy("y").agg((F.max("n") / F.sum("n")).alias("majority"))
    out = []
    for y, majority in sizes.orderBy("y").collect():
        one = sample.filter(F.col("y") == y).select("fold", F.col("source").alias("y"), "features")
        tested = [correct / n for _, n, correct in _cross_validated(one, folds) if n]
        out.append((y, sum(tested) / len(tested) if tested else None, majority))
    return rows.sparkSession.createDataFrame(out, "y long, accuracy double, majority double")


def _features(v: Views) -> DataFrame:
    return v.embeddings.select("vec_id", F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("features"))


@query("ml1_tuned_classifier")
def _ml1(v: Views) -> DataFrame:
    rows = _features(v)
    return train_tuned(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), 10)[1]


@query("ml1_tree_search")
def _ml1b(v: Views) -> DataFrame:
    rows = _features(v)
    return search_trees(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), 10, trials=4, most=16)[1]


@query("l5_feature_ranking")
def _l5(v: Views) -> DataFrame:
    return feature_ranking(_features(v))


def _formats(v: Views) -> DataFrame:
    """Recording properties of the embeddings taken as clips; one source of two is a little louder."""
    n = F.col("vec_id")
    clips = v.embeddings.select(
        n.alias("clip_id"), F.lit(16_000).alias("rate"), (n % 2 + 1).alias("channels"), F.transform("embedding", lambda x: x.cast("double") * (1 + (n % 5 == 0).cast("int"))).alias("samples"),
    )
    found = recording_properties(clips).join(v.embeddings.select(n.alias("clip_id"), F.col("label").alias("y")), "clip_id")
    values = F.array(*(F.col(c).cast("double") for c in ("rate", "channels", "high_share", "zero_share", "level")))
    return found.select(F.col("clip_id").cast("string").alias("key"), "y", (F.col("clip_id") % 97).alias("group_id"), (F.col("clip_id") % 5 == 0).cast("int").alias("source"), values.alias("features"))


@query("ml2_shortcut_probe")
def _ml2(v: Views) -> DataFrame:
    return shortcut_probe(_formats(v))


@query("ml2_source_probe")
def _ml2b(v: Views) -> DataFrame:
    return source_probe(_formats(v).withColumn("y", F.col("y") % 2), folds=3)


@query(
    "ml2_probe_folds",
    """WITH f AS (SELECT vec_id, label % 2 AS y, CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS source, CAST(CAST('0x' || substr(md5(CAST(vec_id % 97 AS VARCHAR)), 1, 8) AS UBIGINT) % 3 AS INTEGER) AS fold FROM embeddings),
    held AS (SELECT y, source FROM f GROUP BY ALL HAVING count(*) >= 20), several AS (SELECT y FROM held GROUP BY y HAVING count(*) > 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY y, source ORDER BY md5('0:' || vec_id), CAST(vec_id AS VARCHAR)) AS r FROM f SEMI JOIN held USING (y, source) SEMI JOIN several USING (y))
    SELECT y, source, fold, count(*) AS n, min(vec_id) AS first_id FROM ranked WHERE r <= 40 GROUP BY y, source, fold""",
)
def _ml2c(v: Views) -> DataFrame:
    """The clips that the source probe learns from and tests: how many of each source lie in each fold."""
    sample = source_sample(_formats(v).withColumn("y", F.col("y") % 2), folds=3)
    return sample.groupBy("y", "source", "fold").agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("first_id"))
