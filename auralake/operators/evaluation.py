"""Score matrices: calibration, aggregation to clips, metrics, comparison of models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions.rules import MIN_CONFIDENCE, RULES, UNKNOWN, WEAK_DIFFERENCE
from auralake.plans.registry import Views, query

R = 6  # digits kept where sums of doubles come in an order that isn't fixed


def confusion(rows: DataFrame, y: str, pred: str, classes: int) -> DataFrame:
    """(y, pred, n) for every pair of classes, zeros included; the dimension has classes ** 2 rows."""
    spark = rows.sparkSession
    one = spark.range(classes * classes)
    grid = one.select(F.floor(F.col("id") / classes).cast("int").alias("y"), (F.col("id") % classes).cast("int").alias("pred"))
    counted = rows.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    return grid.join(counted, ["y", "pred"], "left").fillna(0, ["n"])


def class_metrics(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class of confusion counts; a zero division gives 0."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    side = lambda c, total: matrix.groupBy(*keys, F.col(c).alias("class_no")).agg(F.sum("n").alias(total), F.sum(hit).alias(f"hit_{total}"))
    both = side("y", "support").join(side("pred", "predicted"), [*keys, "class_no"], "full_outer").fillna(0)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.greatest("hit_support", "hit_predicted")
    return both.select(
        *keys,
        "class_no",
        F.col("support").cast("long").alias("support"),
        safe(tp, F.col("predicted")).alias("precision"),
        safe(tp, F.col("support")).alias("recall"),
        safe(2 * tp, F.col("predicted") + F.col("support")).alias("f1"),
    )


def critical_recall(metrics: DataFrame, critical: list) -> DataFrame:
    """One row: the least and the mean recall of the critical classes among class_metrics; null without any."""
    return metrics.filter(F.col("class_no").isin(*critical)).agg(F.round(F.min("recall"), R).alias("least"), F.round(F.avg("recall"), R).alias("mean"))


def calibration_error(top: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over half-open bins (lo, hi] of the top confidence."""
    per = top.groupBy(F.ceil(F.col("conf") * bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg((F.col("pred") == F.col("y")).cast("int")).alias("acc"), F.avg("conf").alias("mean")
    )
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("mean"))) / F.sum("n"), R).alias("ece"))


def calibrated(probs: Column, temperature: Column | float) -> Column:
    """An array of probabilities raised to 1 / T and renormalised, by log and a subtracted maximum."""
    z = F.transform(probs, lambda p: F.log(p + 1e-12) / temperature)
    return normalised(F.transform(z, lambda x: F.exp(x - F.array_max(z))))


def normalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def fit_temperature(rows: DataFrame, rounds: int = 3, steps: int = 13) -> float:
    """T with the smallest mean negative log likelihood, log T in [-3, 3]: a grid in one pass per round, refined around the best.

    rows: y, probs (array in class order).  Rows whose y is no class of the array
    are left out; without rows T is 1.  Each pass reads the rows once and sums
    per grid point map-side.
    """
    low, high = -3.0, 3.0
    logs = rows.select(F.transform("probs", lambda p: F.log(p + 1e-12)).alias("zs"), F.col("y").cast("int").alias("y")).filter(F.col("y").between(0, F.size("zs") - 1))
    best = 0.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        top, own = F.array_max("zs"), F.get("zs", F.col("y"))

        def nll(g: float) -> Column:
            t = math.exp(g)
            total = F.aggregate(F.transform("zs", lambda z: F.exp((z - top) / t)), F.lit(0.0), lambda a, b: a + b)
            return F.avg(F.log(total) - (own - top) / t)

        means = logs.agg(*(nll(g).alias(f"g{i}") for i, g in enumerate(grid))).first()
        if means["g0"] is None:
            return 1.0
        best = min(zip(means, grid, strict=True))[1]
        width = (high - low) / (steps - 1)
        low, high = max(-3.0, best - width), min(3.0, best + width)
    return math.exp(best)


def clip_scores(windows: DataFrame, clips: DataFrame, classes: int, method: str = "mean") -> DataFrame:
    """(clip_id, probs) of every clip: its windows' arrays combined by mean, max or the three most confident windows, renormalised.

    windows: clip_id, window_id, probs; clips: clip_id.  A clip without windows
    gets the uniform distribution.  One row per clip is combined map-side; for
    top3 no more than three windows of a clip leave a task.
    """
    if method not in ("mean", "max", "top3"):
        raise ValueError(f"unknown method {method}")
    if method == "top3":
        w = Window.partitionBy("clip_id").orderBy(F.desc(F.array_max("probs")), "window_id")
        windows = windows.withColumn("_n", F.row_number().over(w)).filter("_n <= 3")
    value = F.max if method == "max" else F.avg
    per = windows.groupBy("clip_id").agg(F.array(*(value(F.get("probs", F.lit(i))) for i in range(classes))).alias("probs"))
    uniform = F.array_repeat(F.lit(1.0 / classes), classes)
    return clips.select("clip_id").join(per, "clip_id", "left").select("clip_id", F.coalesce(normalised(F.col("probs")), uniform).alias("probs"))


def predicted(probs: Column) -> Column:
    """The first class of the largest probability, at nine digits."""
    rounded = F.transform(probs, lambda p: F.round(p, 9))
    return (F.array_position(rounded, F.array_max(rounded)) - 1).cast("int")


def macro_f1(rows: DataFrame, classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: plain mean of F1 over all classes, those without rows counting 0."""
    return class_metrics(confusion(rows, y, pred, classes)).agg(F.round(F.avg("f1"), R).alias("macro_f1"))


def choose_aggregation(windows: DataFrame, clips: DataFrame, classes: int) -> tuple[dict[str, float], str, float]:
    """(macro F1 by method, the best method, the temperature of its clip scores); of equal methods the first of mean, max, top3.

    clips: clip_id, y.  windows are calibrated already.
    """
    scored = {m: clip_scores(windows, clips, classes, m).join(clips.select("clip_id", "y"), "clip_id") for m in ("mean", "max", "top3")}
    f1 = {m: macro_f1(rows.withColumn("pred", predicted(F.col("probs"))), classes).first()[0] for m, rows in scored.items()}
    best = max(f1, key=lambda m: f1[m])
    return f1, best, fit_temperature(scored[best])


def clip_probabilities(windows: DataFrame, clips: DataFrame, classes: int, temperature: float, method: str, clip_temperature: float) -> DataFrame:
    """(clip_id, probs): window scores calibrated, combined per clip and calibrated again."""
    warm = windows.withColumn("probs", calibrated(F.col("probs"), temperature))
    return clip_scores(warm, clips, classes, method).withColumn("probs", calibrated(F.col("probs"), clip_temperature))


def consistency(match: Column, first: Column, second: Column) -> Column:
    """Agreement status of two models' top classes; a missing second score is Uncertain."""
    sure = (first >= MIN_CONFIDENCE) & (second >= MIN_CONFIDENCE)
    return (
        F.when(second.isNull(), "Uncertain")
        .when(match & sure & (F.abs(first - second) <= WEAK_DIFFERENCE), "Acceptable Match")
        .when(match, "Weak Match")
        .when(sure, "Disagreement")
        .otherwise("Uncertain")
    )


def model_summary(rows: DataFrame, critical: list[str], alerting: list[str]) -> DataFrame:
    """One row comparing two models and the decision made of both.

    rows: actual, pred, conf, pred2 and conf2 (null: no result), final_class,
    review (boolean), alert (boolean).  Agreement and who was right count rows
    with both results; missed are critical sounds without alert or review.
    """
    c = F.col
    both, right, right2, end = c("pred2").isNotNull(), c("pred") == c("actual"), c("pred2") == c("actual"), c("final_class") == c("actual")
    agree = both & (c("pred") == c("pred2"))
    disagree = both & (c("pred") != c("pred2"))
    mean = lambda when, x: F.round(F.avg(F.when(when, x)), R)
    return rows.agg(
        F.count("*").alias("scored"), F.count_if(both).alias("compared"), F.count_if(agree).alias("agree"), F.count_if(agree & right).alias("agree_correct"),
        F.count_if(disagree).alias("disagree"), F.count_if(disagree & right).alias("disagree_first_right"), F.count_if(disagree & right2).alias("disagree_second_right"),
        mean(both, F.abs(c("conf") - c("conf2"))).alias("confidence_difference"), mean(right, c("conf")).alias("confidence_right"), mean(~right, c("conf")).alias("confidence_wrong"),
        mean(right2, c("conf2")).alias("confidence2_right"), mean(both & ~right2, c("conf2")).alias("confidence2_wrong"),
        F.count_if("review").alias("review"), F.count_if(c("review") & ~end).alias("review_wrong"), F.count_if(~end).alias("wrong"),
        F.count_if("alert").alias("alerts"), F.count_if(c("alert") & end).alias("alerts_true"), F.count_if(c("actual").isin(*alerting)).alias("alerting_actual"),
        F.count_if(c("actual").isin(*critical) & ~c("alert") & ~c("review")).alias("missed_critical"), F.count_if(c("final_class") == UNKNOWN).alias("unknown"),
    )


def consistency_summary(rows: DataFrame) -> DataFrame:
    """(consistency, n, correct): how often each agreement status came up, and how often the final class was then right."""
    return rows.groupBy("consistency").agg(F.count("*").alias("n"), F.count_if(F.col("final_class") == F.col("actual")).alias("correct"))


def model_metrics(rows: DataFrame) -> DataFrame:
    """(model, accuracy, macro_precision, macro_recall, macro_f1) of first, second and final, over the classes that occur as actual."""
    pred = F.array(
        *(F.struct(F.lit(m).alias("model"), F.coalesce(F.col(c), F.lit("(no result)")).alias("pred")) for m, c in (("first", "pred"), ("second", "pred2"), ("final", "final_class")))
    )
    counted = rows.select("actual", F.explode(pred).alias("x")).groupBy("x.model", F.col("actual").alias("y"), "x.pred").agg(F.count("*").alias("n"))
    per = class_metrics(counted, ("model",)).filter("support > 0")
    macro = per.groupBy("model").agg(*(F.round(F.avg(c), R).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    hit = counted.groupBy("model").agg(F.round(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), R).alias("accuracy"))
    return hit.join(macro, "model")


def threshold_study(top: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """(threshold, share, above, below): share of rows at or above each threshold of a column, accuracy there and below (null: no rows).

    top: pred, y and the column.  The list is a parameter; every threshold is a
    few sums of one pass.
    """
    hit = (F.col("pred") == F.col("y")).cast("int")
    at = lambda t: F.col(column) >= t
    each = [
        F.struct(F.lit(t).alias("threshold"), F.round(F.avg(at(t).cast("int")), R).alias("share"), F.round(F.avg(F.when(at(t), hit)), R).alias("above"), F.round(F.avg(F.when(~at(t), hit)), R).alias("below"))
        for t in thresholds
    ]
    return top.agg(*(e.alias(f"t{i}") for i, e in enumerate(each))).select(F.explode(F.array(*(f"t{i}" for i in range(len(each))))).alias("x")).select("x.*")


def critical_reach(top: DataFrame, critical: list, thresholds: list[float]) -> DataFrame:
    """(y, threshold, recall): share of a critical class's rows that are predicted as it with at least the threshold's confidence."""
    hit = (F.col("pred") == F.col("y")).cast("int")
    each = [F.struct(F.lit(t).alias("threshold"), F.round(F.avg(hit * (F.col("conf") >= t).cast("int")), R).alias("recall")) for t in thresholds]
    per = top.filter(F.col("y").isin(*critical)).groupBy("y").agg(F.array(*each).alias("x"))
    return per.select("y", F.explode("x").alias("x")).select("y", "x.*")


def robustness(counts: DataFrame, clean: str) -> DataFrame:
    """(model, condition, macro_f1, mean, retained): macro F1 per condition, its mean over all but `clean`, and that mean over the clean one.

    counts: model, condition, y, pred, n.  retained is 0 where the clean score is.
    """
    per = class_metrics(counts, ("model", "condition")).groupBy("model", "condition").agg(F.avg("f1").alias("f1"))
    is_clean = F.col("condition") == clean
    whole = per.groupBy("model").agg(F.avg(F.when(~is_clean, F.col("f1"))).alias("mean"), F.max(F.when(is_clean, F.col("f1"))).alias("clean"))
    retained = F.when(F.col("clean") > 0, F.col("mean") / F.col("clean")).otherwise(0.0)
    return per.join(whole, "model").select("model", "condition", F.round("f1", R).alias("macro_f1"), F.round("mean", R).alias("mean"), F.round(retained, R).alias("retained"))


def results_by_id(clips: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """clips with pred2 and error of the second model's results: a clip without a row there keeps its place, with 'no result' as error."""
    joined = clips.join(second.select(key, "pred2", "error"), key, "left")
    return joined.withColumn("error", F.when(F.col("pred2").isNotNull(), "").otherwise(F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("no result"))))


def select_model(metas: DataFrame, critical_recall: float = 0.85, slack: float = 0.01) -> DataFrame:
    """The chosen model's row: critical recalls in order if any model has that, within slack of the best F1, then mean critical recall, then speed.

    metas: model, f1, min_critical_recall, mean_critical_recall, ms; a handful of rows.
    """
    whole = Window.partitionBy(F.lit(1))
    safe = metas.withColumn("ok", F.col("min_critical_recall") >= critical_recall)
    pool = safe.withColumn("any", F.max("ok").over(whole)).filter("ok OR NOT any").withColumn("best", F.max("f1").over(whole))
    return pool.filter(F.col("f1") >= F.col("best") - slack).orderBy(F.desc("mean_critical_recall"), "ms", "model").limit(1).select("model")


_C = "(SELECT a.i AS y, b.i AS pred, count(t.window_id) AS n FROM range(10) a(i) CROSS JOIN range(10) b(i) LEFT JOIN {top_scores} t ON t.y = a.i AND t.pred = b.i GROUP BY a.i, b.i)"


@query("a19_confusion_matrix", f"SELECT CAST(y AS INTEGER) AS y, CAST(pred AS INTEGER) AS pred, n FROM {_C}")
def _a19(v: Views) -> DataFrame:
    return confusion(v.top_scores, "y", "pred", 10)


@query(
    "a20_class_metrics",
    f"""SELECT CAST(c AS INTEGER) AS class_no, CAST(sup AS BIGINT) AS support, CASE WHEN pre > 0 THEN tp / pre ELSE 0 END AS precision, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall,
    CASE WHEN pre + sup > 0 THEN 2 * tp / (pre + sup) ELSE 0 END AS f1 FROM (SELECT c.i AS c, sum(n) FILTER (y = c.i) AS sup, sum(n) FILTER (pred = c.i) AS pre, sum(n) FILTER (y = c.i AND pred = c.i) AS tp FROM range(10) c(i) CROSS JOIN {_C} GROUP BY c.i)""",
)
def _a20(v: Views) -> DataFrame:
    return class_metrics(confusion(v.top_scores, "y", "pred", 10))


@query(
    "a20_accuracy_and_macro",
    f"""SELECT round(acc, 6) AS accuracy, round(f, 6) AS macro_f1 FROM (SELECT sum(n) FILTER (y = pred) / sum(n) AS acc FROM {_C}),
    (SELECT avg(CASE WHEN pre + sup > 0 THEN 2 * tp / (pre + sup) ELSE 0 END) AS f FROM (SELECT c.i, sum(n) FILTER (y = c.i) AS sup, sum(n) FILTER (pred = c.i) AS pre, sum(n) FILTER (y = c.i AND pred = c.i) AS tp FROM range(10) c(i) CROSS JOIN {_C} GROUP BY c.i))""",
)
def _a20b(v: Views) -> DataFrame:
    matrix = confusion(v.top_scores, "y", "pred", 10)
    total = matrix.agg(F.round(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n"))) / F.sum("n"), R).alias("accuracy"))
    return total.join(F.broadcast(class_metrics(matrix).agg(F.round(F.avg("f1"), R).alias("macro_f1"))))  # one row each


@query(
    "a21_calibration_error",
    "SELECT round(sum(n * abs(acc - mean)) / sum(n), 6) AS ece FROM (SELECT ceil(conf * 10) AS b, count(*) AS n, avg(CAST(pred = y AS INTEGER)) AS acc, avg(conf) AS mean FROM {top_scores} GROUP BY 1)",
)
def _a21(v: Views) -> DataFrame:
    return calibration_error(v.top_scores)


@query(
    "a20_critical_recall",
    f"SELECT round(min(r), 6) AS least, round(avg(r), 6) AS mean FROM (SELECT y, CASE WHEN sum(n) > 0 THEN sum(n) FILTER (y = pred) / sum(n) ELSE 0 END AS r FROM {_C} WHERE y IN (1, 4, 7) GROUP BY y)",
)
def _a20c(v: Views) -> DataFrame:
    return critical_recall(class_metrics(confusion(v.top_scores, "y", "pred", 10)), [1, 4, 7])


def _windows(v: Views, p: str = "p") -> DataFrame:
    """The long score table as one array per window."""
    ordered = F.array_sort(F.collect_list(F.struct("class_no", p)))
    return v.scores.groupBy("window_id", "clip_id", "y").agg(F.transform(ordered, lambda x: x[p]).alias("probs"))


def _long(rows: DataFrame, key: str, name: str = "p") -> DataFrame:
    return rows.select(key, F.posexplode("probs").alias("class_no", "x")).select(key, "class_no", F.round("x", R).alias(name))


def _temperature_sql(rows: str, rounds: int = 3) -> str:
    """T by the same grids: rows (id, own, z) of log probabilities."""
    text, low, high = f"WITH z AS {rows}", "-3.0::DOUBLE", "3.0::DOUBLE"
    for i in range(rounds):
        text += f""", b{i} AS (SELECT arg_min(g, nll) AS b, any_value(w) AS w FROM (SELECT g, any_value(w) AS w, avg(nll) AS nll FROM (SELECT id, g, any_value(w) AS w, ln(sum(exp((z - m) / exp(g)))) - (max(CASE WHEN own THEN z END) - max(m)) / exp(g) AS nll
        FROM (SELECT *, max(z) OVER (PARTITION BY id) AS m FROM z) CROSS JOIN (SELECT lo + (hi - lo) * i / 12 AS g, (hi - lo) / 12 AS w FROM range(13) t(i), (SELECT {low} AS lo, {high} AS hi)) GROUP BY id, g) WHERE nll IS NOT NULL GROUP BY g))"""
        low, high = f"(SELECT greatest(-3.0, b - w) FROM b{i})", f"(SELECT least(3.0, b + w) FROM b{i})"
    return text + f" SELECT round(exp(b), 4) AS temperature FROM b{rounds - 1}"


@query("a22_temperature_fit", _temperature_sql("(SELECT window_id AS id, class_no = y AS own, ln(p + 1e-12) AS z FROM {scores})"))
def _a22(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(round(fit_temperature(_windows(v)), 4),)], "temperature double")


_CLIPS = "(SELECT DISTINCT c_custkey % 260 AS clip_id FROM customer)"
_CLIP = {
    "mean": "(SELECT clip_id, class_no, avg(p) AS p FROM {scores} GROUP BY 1, 2)",
    "max": "(SELECT clip_id, class_no, max(p) AS p FROM {scores} GROUP BY 1, 2)",
    "top3": "(SELECT clip_id, class_no, avg(p) AS p FROM {scores} s JOIN (SELECT window_id AS w FROM (SELECT clip_id, window_id, row_number() OVER (PARTITION BY clip_id ORDER BY max(p) DESC, window_id) AS n FROM {scores} GROUP BY clip_id, window_id) WHERE n <= 3) ON w = window_id GROUP BY 1, 2)",
}
for _method, _sql in _CLIP.items():
    query(
        f"a23_clip_scores_{_method}",
        f"SELECT c.clip_id, CAST(n.i AS INTEGER) AS class_no, round(coalesce(p / sum(p) OVER (PARTITION BY c.clip_id), 0.1), 6) AS p FROM {_CLIPS} c CROSS JOIN range(10) n(i) LEFT JOIN {_sql} s ON s.clip_id = c.clip_id AND s.class_no = n.i",
    )(lambda v, m=_method: _long(clip_scores(_windows(v), _clips(v), 10, m), "clip_id"))


def _clips(v: Views) -> DataFrame:
    """Clip numbers, some of which have no windows."""
    return v.customer.select((F.col("c_custkey") % 260).alias("clip_id")).distinct()


_TRUTH = "(SELECT clip_id AS c, CAST(max(y) AS INTEGER) AS y FROM {scores} GROUP BY clip_id)"
_PRED = "(SELECT clip_id, y, class_no AS pred FROM (SELECT clip_id, y, class_no, row_number() OVER (PARTITION BY clip_id ORDER BY round(p / t, 9) DESC, class_no) AS r FROM (SELECT *, sum(p) OVER (PARTITION BY clip_id) AS t FROM {0}) JOIN {1} ON c = clip_id) WHERE r = 1)"


def _macro_sql(pred: str) -> str:
    return f"""(SELECT round(avg(CASE WHEN a + b > 0 THEN 2 * h / (a + b) ELSE 0 END), 6) FROM (SELECT i, (SELECT count(*) FROM {pred} WHERE y = i) AS a, (SELECT count(*) FROM {pred} WHERE pred = i) AS b,
    (SELECT count(*) FROM {pred} WHERE y = i AND pred = i) AS h FROM range(10) t(i)))"""


@query(
    "a24_aggregation_choice",
    "WITH "
    + ", ".join(f"{m}_p AS {_PRED.replace('{0}', s).replace('{1}', _TRUTH)}" for m, s in _CLIP.items())
    + " SELECT method, macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, no) = 1 AS chosen FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS no, '{m}' AS method, {_macro_sql(m + '_p')} AS macro_f1" for i, m in enumerate(_CLIP))
    + ")",
)
def _a24(v: Views) -> DataFrame:
    clips = v.scores.groupBy("clip_id").agg(F.max("y").alias("y"))
    f1, best, _ = choose_aggregation(_windows(v), clips, 10)
    return v.spark.createDataFrame([(m, x, m == best) for m, x in f1.items()], "method string, macro_f1 double, chosen boolean")


@query(
    "a24_clip_temperature",
    _temperature_sql("(SELECT s.clip_id AS id, class_no = y AS own, ln(p / sum(p) OVER (PARTITION BY s.clip_id) + 1e-12) AS z FROM " + _CLIP["max"] + " s JOIN " + _TRUTH + " ON c = s.clip_id)"),
)
def _a24b(v: Views) -> DataFrame:
    clips = v.scores.groupBy("clip_id").agg(F.max("y").alias("y"))
    rows = clip_scores(_windows(v), clips, 10, "max").join(clips, "clip_id")
    return v.spark.createDataFrame([(round(fit_temperature(rows), 4),)], "temperature double")


_CRITICAL = [r[0] for r in RULES if r[1]]
_ALERTING = [r[0] for r in RULES if r[2]]
_names = lambda names: ", ".join(f"'{n}'" for n in names)
_COMPARED = """(SELECT reference_class AS actual, python_class AS pred, python_confidence AS conf, nullif(gtm_class, '') AS pred2, gtm_confidence AS conf2, final_class, review_required AS review, alert_status = 'Alert generated' AS alert, consistency
    FROM {sound_events} WHERE reference_class <> '')"""


def _compared(v: Views) -> DataFrame:
    c = F.col
    return v.sound_events.filter("reference_class <> ''").select(
        c("reference_class").alias("actual"), c("python_class").alias("pred"), c("python_confidence").alias("conf"), F.nullif("gtm_class", F.lit("")).alias("pred2"), c("gtm_confidence").alias("conf2"),
        "final_class", c("review_required").alias("review"), (c("alert_status") == "Alert generated").alias("alert"), "consistency",
    )


@query(
    "a25_model_summary",
    f"""SELECT count(*) AS scored, count(pred2) AS compared, count(*) FILTER (pred = pred2) AS agree, count(*) FILTER (pred = pred2 AND pred = actual) AS agree_correct, count(*) FILTER (pred <> pred2) AS disagree,
    count(*) FILTER (pred <> pred2 AND pred = actual) AS disagree_first_right, count(*) FILTER (pred <> pred2 AND pred2 = actual) AS disagree_second_right, round(avg(abs(conf - conf2)), 6) AS confidence_difference,
    round(avg(conf) FILTER (pred = actual), 6) AS confidence_right, round(avg(conf) FILTER (pred <> actual), 6) AS confidence_wrong, round(avg(conf2) FILTER (pred2 = actual), 6) AS confidence2_right,
    round(avg(conf2) FILTER (pred2 <> actual), 6) AS confidence2_wrong, count(*) FILTER (review) AS review, count(*) FILTER (review AND final_class <> actual) AS review_wrong, count(*) FILTER (final_class <> actual) AS wrong,
    count(*) FILTER (alert) AS alerts, count(*) FILTER (alert AND final_class = actual) AS alerts_true, count(*) FILTER (actual IN ({_names(_ALERTING)})) AS alerting_actual,
    count(*) FILTER (actual IN ({_names(_CRITICAL)}) AND NOT alert AND NOT review) AS missed_critical, count(*) FILTER (final_class = 'Unknown') AS unknown FROM {_COMPARED}""",
)
def _a25(v: Views) -> DataFrame:
    return model_summary(_compared(v), _CRITICAL, _ALERTING)


@query("a25_consistency", f"SELECT consistency, count(*) AS n, count(*) FILTER (final_class = actual) AS correct FROM {_COMPARED} GROUP BY consistency")
def _a25b(v: Views) -> DataFrame:
    return consistency_summary(_compared(v))


@query(
    "a25_model_metrics",
    f"""WITH r AS (SELECT actual, model, p FROM (SELECT actual, unnest(['first', 'second', 'final']) AS model, unnest([pred, coalesce(pred2, '(no result)'), final_class]) AS p FROM {_COMPARED})),
    k AS (SELECT m.model, c.c, (SELECT count(*) FROM r WHERE r.model = m.model AND actual = c) AS sup, (SELECT count(*) FROM r WHERE r.model = m.model AND p = c) AS pre, (SELECT count(*) FROM r WHERE r.model = m.model AND p = c AND actual = c) AS tp
    FROM (SELECT DISTINCT model FROM r) m CROSS JOIN (SELECT DISTINCT actual AS c FROM r) c)
    SELECT k.model, (SELECT round(count(*) FILTER (actual = p) / count(*), 6) FROM r WHERE r.model = k.model) AS accuracy, round(avg(CASE WHEN pre > 0 THEN tp / pre ELSE 0 END), 6) AS macro_precision, round(avg(tp / sup), 6) AS macro_recall,
    round(avg(2 * tp / (pre + sup)), 6) AS macro_f1 FROM k GROUP BY k.model""",
)
def _a25c(v: Views) -> DataFrame:
    return model_metrics(_compared(v))


@query("a26_accuracy_per_source", "SELECT clip_id % 7 AS source, count(*) AS clips, count(*) FILTER (pred = y) / count(*) AS accuracy FROM {top_scores} GROUP BY 1")
def _a26(v: Views) -> DataFrame:
    return v.top_scores.groupBy((F.col("clip_id") % 7).alias("source")).agg(F.count("*").alias("clips"), (F.count_if(F.col("pred") == F.col("y")) / F.count("*")).alias("accuracy"))


_AT = "SELECT threshold, round(avg(CAST({0} >= threshold AS INTEGER)), 6) AS share, round(avg(CAST(pred = y AS INTEGER)) FILTER ({0} >= threshold), 6) AS above, round(avg(CAST(pred = y AS INTEGER)) FILTER ({0} < threshold), 6) AS below FROM {{top_scores}} CROSS JOIN (VALUES {1}) t(threshold) GROUP BY threshold"


@query("a27_threshold_study", _AT.format("conf", "(0.0::DOUBLE), (0.13), (0.15), (0.2), (0.99)"))
def _a27(v: Views) -> DataFrame:
    return threshold_study(v.top_scores, "conf", [0.0, 0.13, 0.15, 0.2, 0.99])


@query("a27_margin_study", _AT.format("(conf - second)", "(0.003::DOUBLE), (0.01), (0.05)"))
def _a27b(v: Views) -> DataFrame:
    return threshold_study(v.top_scores.withColumn("margin", F.col("conf") - F.col("second")), "margin", [0.003, 0.01, 0.05])


@query("a27_critical_reach", "SELECT y, threshold, round(avg(CAST(pred = y AND conf >= threshold AS INTEGER)), 6) AS recall FROM {top_scores} CROSS JOIN (VALUES (0.0::DOUBLE), (0.13), (0.15)) t(threshold) WHERE y IN (1, 4, 7) GROUP BY y, threshold")
def _a27c(v: Views) -> DataFrame:
    return critical_reach(v.top_scores, [1, 4, 7], [0.0, 0.13, 0.15])


_CONDITION = "(SELECT model, condition, y, pred, count(*) AS n FROM (SELECT 'a' AS model, CASE clip_id % 4 WHEN 0 THEN 'clean' ELSE 'noise ' || clip_id % 4 END AS condition, y, pred FROM {top_scores} UNION ALL SELECT 'b', CASE clip_id % 4 WHEN 0 THEN 'clean' ELSE 'noise ' || clip_id % 4 END, y, pred2 FROM {top_scores}) GROUP BY ALL)"


@query(
    "a28_robustness",
    f"""WITH f AS (SELECT model, condition, avg(f1) AS f1 FROM (SELECT model, condition, c, CASE WHEN coalesce(pre, 0) + coalesce(sup, 0) > 0 THEN 2 * coalesce(tp, 0) / (coalesce(pre, 0) + coalesce(sup, 0)) ELSE 0 END AS f1 FROM (
    SELECT model, condition, c, sum(n) FILTER (y = c) AS sup, sum(n) FILTER (pred = c) AS pre, sum(n) FILTER (y = c AND pred = c) AS tp FROM {_CONDITION} CROSS JOIN (SELECT i AS c FROM range(10) t(i)) GROUP BY model, condition, c HAVING sup > 0 OR pre > 0)) GROUP BY model, condition),
    m AS (SELECT model, avg(f1) FILTER (condition <> 'clean') AS mean, max(f1) FILTER (condition = 'clean') AS clean FROM f GROUP BY model)
    SELECT f.model, condition, round(f1, 6) AS macro_f1, round(mean, 6) AS mean, round(CASE WHEN clean > 0 THEN mean / clean ELSE 0 END, 6) AS retained FROM f JOIN m ON m.model = f.model""",
)
def _a28(v: Views) -> DataFrame:
    condition = F.when(F.col("clip_id") % 4 == 0, "clean").otherwise(F.concat(F.lit("noise "), (F.col("clip_id") % 4).cast("string")))
    models = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("pred").alias("pred")), F.struct(F.lit("b").alias("model"), F.col("pred2").alias("pred"))))
    rows = v.top_scores.select(condition.alias("condition"), "y", models.alias("x")).select("condition", "y", "x.*")
    return robustness(rows.groupBy("model", "condition", "y", "pred").agg(F.count("*").alias("n")), "clean")


@query(
    "a29_false_alarms",
    "SELECT pred, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, count(*) / sum(count(*)) OVER () > 0.2 AS flagged FROM {top_scores} WHERE y = 0 GROUP BY pred",
)
def _a29(v: Views) -> DataFrame:
    per = v.top_scores.filter("y = 0").groupBy("pred").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return per.join(F.broadcast(total)).select("pred", "n", share.alias("share"), (share > 0.2).alias("flagged"))  # one row


_METAS = """(SELECT 'm' || CAST(m AS STRING) AS model, CAST(f AS DOUBLE) / n AS f1, CAST(lo AS DOUBLE) / n AS min_critical_recall, CAST(f + lo AS DOUBLE) / n AS mean_critical_recall, m AS ms FROM (
    SELECT clip_id % 5 AS m, count(*) AS n, sum(CASE WHEN pred = y THEN 1 ELSE 0 END) AS f, sum(CASE WHEN pred2 = y THEN 1 ELSE 0 END) AS lo FROM {top_scores} GROUP BY clip_id % 5) t)"""


@query(
    "a30_model_selection",
    f"""WITH m AS (SELECT *, min_critical_recall >= 0.1 AS ok FROM {_METAS}), p AS (SELECT * FROM m WHERE ok OR NOT (SELECT bool_or(ok) FROM m))
    SELECT model FROM p WHERE f1 >= (SELECT max(f1) FROM p) - 0.01 ORDER BY mean_critical_recall DESC, ms, model LIMIT 1""",
)
def _a30(v: Views) -> DataFrame:
    per = v.top_scores.groupBy((F.col("clip_id") % 5).alias("ms")).agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("y")).alias("f"), F.count_if(F.col("pred2") == F.col("y")).alias("lo")
    )
    metas = per.select(
        F.concat(F.lit("m"), F.col("ms").cast("string")).alias("model"), (F.col("f") / F.col("n")).alias("f1"), (F.col("lo") / F.col("n")).alias("min_critical_recall"),
        ((F.col("f") + F.col("lo")) / F.col("n")).alias("mean_critical_recall"), "ms",
    )
    return select_model(metas, critical_recall=0.1)


@query(
    "u8_clip_probabilities",
    f"""SELECT c.clip_id, CAST(n.i AS INTEGER) AS class_no, round(coalesce(e / sum(e) OVER (PARTITION BY c.clip_id), 0.1), 6) AS p FROM {_CLIPS} c CROSS JOIN range(10) n(i) LEFT JOIN (
    SELECT clip_id, class_no, pow(p / sum(p) OVER (PARTITION BY clip_id) + 1e-12, 1 / 0.8) AS e FROM (SELECT clip_id, class_no, max(w) AS p FROM (
    SELECT clip_id, window_id, class_no, pow(p + 1e-12, 1 / 1.3) / sum(pow(p + 1e-12, 1 / 1.3)) OVER (PARTITION BY window_id) AS w FROM {{scores}}) GROUP BY clip_id, class_no)) s ON s.clip_id = c.clip_id AND s.class_no = n.i""",
)
def _u8(v: Views) -> DataFrame:
    """Window scores calibrated, combined per clip, calibrated again; clips without windows stay uniform."""
    return _long(clip_probabilities(_windows(v), _clips(v), 10, 1.3, "max", 0.8), "clip_id")


@query(
    "sc8_temperature_softmax",
    "SELECT window_id, CAST(class_no AS INTEGER) AS class_no, round(e / sum(e) OVER (PARTITION BY window_id), 6) AS calibrated FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY window_id)) AS e FROM (SELECT *, ln(p + 1e-12) / 1.7 AS z FROM {scores}))",
)
def _sc8(v: Views) -> DataFrame:
    return _long(_windows(v).withColumn("probs", calibrated(F.col("probs"), 1.7)), "window_id", "calibrated")


@query(
    "sc15_soft_voting",
    "SELECT window_id, CAST(class_no AS INTEGER) AS class_no, round((a / sum(a) OVER w + b / sum(b) OVER w) / 2, 6) AS p FROM (SELECT window_id, class_no, pow(p + 1e-12, 1 / 1.5) AS a, pow(p2 + 1e-12, 1 / 0.8) AS b FROM {scores}) WINDOW w AS (PARTITION BY window_id)",
)
def _sc15(v: Views) -> DataFrame:
    both = F.array_sort(F.collect_list(F.struct("class_no", "p", "p2")))
    rows = v.scores.groupBy("window_id").agg(both.alias("s"))
    one, two = calibrated(F.transform("s", lambda x: x["p"]), 1.5), calibrated(F.transform("s", lambda x: x["p2"]), 0.8)
    return _long(rows.withColumn("probs", F.zip_with(one, two, lambda a, b: (a + b) / 2)), "window_id")


_STATUS = """CASE WHEN gtm_confidence IS NULL THEN 'Uncertain' WHEN class_match AND python_confidence >= 0.5 AND gtm_confidence >= 0.5 AND abs(python_confidence - gtm_confidence) <= 0.3 THEN 'Acceptable Match'
    WHEN class_match THEN 'Weak Match' WHEN python_confidence >= 0.5 AND gtm_confidence >= 0.5 THEN 'Disagreement' ELSE 'Uncertain' END"""


@query("sc12_consistency", f"SELECT event_id, {_STATUS} AS consistency FROM {{sound_events}}")
def _sc12(v: Views) -> DataFrame:
    return v.sound_events.select("event_id", consistency(F.col("class_match"), F.col("python_confidence"), F.col("gtm_confidence")).alias("consistency"))


@query(
    "p12_major_disagreement",
    "SELECT event_id FROM {sound_events} WHERE gtm_class <> '' AND NOT class_match AND (python_class IN ('Gunshot', 'Glass Breaking') OR gtm_class IN ('Gunshot', 'Glass Breaking') OR reference_class IN ('Gunshot', 'Glass Breaking') OR python_confidence >= 0.6 OR gtm_confidence >= 0.6)",
)
def _p12(v: Views) -> DataFrame:
    critical = lambda c: F.col(c).isin(*_CRITICAL)
    major = critical("python_class") | critical("gtm_class") | critical("reference_class") | (F.greatest("python_confidence", "gtm_confidence") >= 0.6)
    return v.sound_events.filter((F.col("gtm_class") != "") & ~F.col("class_match") & major).select("event_id")


@query(
    "w10_ranked_scores",
    """SELECT window_id, pred AS top, round(conf, 9) AS confidence, round(conf - second, 9) AS margin, (SELECT string_agg(class_no, ',' ORDER BY p DESC, class_no) FROM (SELECT class_no, p, row_number() OVER (ORDER BY p DESC, class_no) AS r FROM {scores} s WHERE s.window_id = t.window_id) WHERE r <= 3) AS top3 FROM {top_scores} t""",
)
def _w10(v: Views) -> DataFrame:
    ranked = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("m"), i.alias("k"))))
    margin = -ranked[0]["m"] + F.coalesce(F.get(ranked, F.lit(1))["m"], F.lit(0.0))
    top3 = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["k"].cast("string")), ",")
    return _windows(v).select("window_id", ranked[0]["k"].alias("top"), F.round(-ranked[0]["m"], 9).alias("confidence"), F.round(margin, 9).alias("margin"), top3.alias("top3"))


@query(
    "j6_results_by_id",
    """SELECT a.window_id, a.pred, b.pred2, CASE WHEN b.window_id IS NULL THEN 'no result' WHEN b.pred2 IS NULL THEN 'timeout' ELSE '' END AS error FROM {top_scores} a
    LEFT JOIN (SELECT window_id, CASE WHEN window_id % 5 <> 1 THEN pred2 END AS pred2 FROM {top_scores} WHERE window_id % 3 <> 0) b ON a.window_id = b.window_id""",
)
def _j6(v: Views) -> DataFrame:
    lost = F.col("window_id") % 5 == 1
    second = v.top_scores.filter("window_id % 3 <> 0").select("window_id", F.when(~lost, F.col("pred2")).alias("pred2"), F.when(lost, "timeout").otherwise("").alias("error"))
    return results_by_id(v.top_scores.select("window_id", "pred"), second, "window_id")
