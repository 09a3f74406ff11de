"""The final decision on a sound: class, level, severity, alert, review reasons and status, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.functions.rules import (
    BACKGROUND, GRADES, MIN_CONFIDENCE, NON_EVENTS, OVERLAP, TOP_TWO_MARGIN, UNKNOWN, UNKNOWN_BELOW, parse_rules, rank, rank_sql, rule_sql,
    rule_table, with_rule,
)
from auralake.operators.evaluation import consistency
from auralake.plans.registry import Views, query

# The reasons for a manual review, in their order.
R_NO_SECOND, R_DISAGREE, R_LOW = "GTM result unavailable", "Different predictions from the two models", "Low confidence"
R_POOR, R_SIMILAR, R_OVERLAP = "Poor audio quality", "Similar top-class confidence scores", "Overlapping sounds"
R_UNSUPPORTED, R_FALSE, R_CRITICAL = "Unsupported sound pattern", "Possible false alarm", "Critical event without sufficient model agreement"


def overlapping_classes(windows: str, threshold: float = OVERLAP) -> Column:
    """Sorted event classes that share a window with another one, each at or above the threshold.

    windows: array of windows, each an array of (class, p); null gives an empty array.
    """
    strong = F.transform(
        F.col(windows),
        lambda w: F.transform(F.filter(w, lambda s: (s["p"] >= threshold) & ~s["class"].isin(*NON_EVENTS)), lambda s: s["class"]),
    )
    found = F.array_sort(F.array_distinct(F.flatten(F.filter(strong, lambda w: F.size(w) >= 2))))
    return F.coalesce(found, F.array().cast("array<string>"))


def decide(df: DataFrame, rules: DataFrame, live: bool = False) -> DataFrame:
    """df with the decision columns.

    Needs python_class, python_confidence, python_margin, gtm_class ('' = no
    result), gtm_confidence, quality_grade, repeated_detections, n_windows,
    noise_dbfs (null = unknown) and overlaps (array).  Offline, required repeats
    are capped by the number of windows; live they aren't.  A disabled rule counts
    as none.  conditions maps each condition of a class that can raise an alert to
    whether it held.
    """
    c = F.col
    match = c("gtm_confidence").isNotNull() & (c("gtm_class") == c("python_class"))
    unknown = (c("python_confidence") < UNKNOWN_BELOW) | (c("quality_grade") == "Unusable")
    df = with_rule(df.withColumns({"match": match, "unknown": unknown, "final_class": F.when(unknown, UNKNOWN).otherwise(c("python_class"))}), rules, "final_class")
    repeats = F.when(c("unknown"), 0).otherwise(c("repeated_detections")) if not live else c("repeated_detections")
    needed = c("rule_consecutive_detections") if live else F.least("rule_consecutive_detections", "n_windows")
    noisy = (c("final_class") == BACKGROUND) & F.coalesce(c("noise_dbfs") > c("rule_noise_limit_dbfs"), F.lit(False))
    raises = F.when(noisy, F.coalesce("rule_noise_alert", "rule_alert")).otherwise(c("rule_alert")) & ~c("unknown")
    grade = rank("quality_grade", GRADES)
    conditions = {
        "confidence": c("python_confidence") >= c("rule_min_confidence"),
        "margin": c("python_margin") >= c("rule_top_two_margin"),
        "repeats": repeats >= needed,
        "quality": grade <= rank("rule_min_quality", GRADES),
    }
    agree = F.when(c("rule_require_model_agreement"), c("match"))
    passed = conditions["confidence"] & conditions["margin"] & conditions["repeats"] & conditions["quality"] & F.coalesce(agree, F.lit(True))
    checked = F.create_map(*[x for k, v in conditions.items() for x in (F.lit(k), v)])
    checked = F.when(agree.isNull(), checked).otherwise(F.map_concat(checked, F.create_map(F.lit("agreement"), agree)))
    df = df.withColumns(
        {
            "raises": raises,
            "alert_status": F.when(~raises, "No alert").when(passed, "Alert generated").otherwise("Not confirmed"),
            "conditions": F.when(raises, checked),
            "recommended_action": F.when(noisy, F.coalesce("rule_noise_action", "rule_recommended_action")).otherwise(c("rule_recommended_action")),
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(c("gtm_confidence").isNull(), R_NO_SECOND).when(~c("match"), R_DISAGREE),
            F.when(c("python_confidence") < MIN_CONFIDENCE, R_LOW),
            F.when(grade >= GRADES.index("Poor"), R_POOR),
            F.when(c("python_margin") < TOP_TWO_MARGIN, R_SIMILAR),
            F.when(F.size("overlaps") > 0, R_OVERLAP),
            F.when(c("unknown"), R_UNSUPPORTED),
            F.when(c("alert_status") == "Not confirmed", R_FALSE),
            F.when(c("rule_critical") & ~c("unknown") & ~c("match"), R_CRITICAL),
        )
    )
    raised = F.coalesce((c("python_confidence") >= c("rule_raise_confidence")) & (repeats >= c("rule_raise_repeats")), F.lit(False))
    calm = F.when(noisy, F.coalesce("rule_noise_severity", "rule_severity")).otherwise(c("rule_severity"))
    severity = F.when((c("alert_status") == "Alert generated") & raised, "Critical").otherwise(calm)
    sure = (c("python_confidence") >= F.greatest(F.lit(0.8), "rule_min_confidence")) & (c("python_margin") >= TOP_TWO_MARGIN)
    agreed = consistency(c("match"), c("python_confidence"), c("gtm_confidence")) == "Acceptable Match"
    level = F.when(sure & agreed, "High").when(c("python_confidence") >= MIN_CONFIDENCE, "Medium").otherwise("Low")
    uncertain = F.arrays_overlap("review_reasons", F.array(*map(F.lit, (R_DISAGREE, R_LOW, R_POOR, R_SIMILAR, R_OVERLAP, R_NO_SECOND))))
    status = (
        F.when(c("alert_status") == "Alert generated", "Alert Generated").when(uncertain, "Uncertain").when(F.size("review_reasons") > 0, "Manual Review").otherwise("Classified")
    )
    df = df.withColumns({"review_reasons": reasons, "severity": severity, "confidence_level": level})
    return df.withColumn("status", status).drop("raises", "match", "unknown")


def _decision_input(v: Views) -> DataFrame:
    n = F.col("event_id")
    return v.scored_events.withColumns(
        {
            "repeated_detections": (F.col("k") % 4).cast("int"),
            "n_windows": (n % 3 + 1).cast("int"),
            "noise_dbfs": F.when(n % 10 != 0, -(F.col("k") % 60).cast("double")),
            "overlaps": F.when(n % 8 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")),
        }
    )


def _decision_rules(spark: SparkSession) -> DataFrame:
    """The rules with one class disabled, one that needs both models and one that becomes Critical, so that every branch has rows."""
    at = lambda name, value, column: F.when(F.col("category") == name, F.lit(value)).otherwise(F.col(column))
    return rule_table(spark).withColumns(
        {
            "enabled": F.col("category") != "Animal Sound",
            "require_model_agreement": F.col("category") == "Machinery Fault",
            "raise_confidence": at("Glass Breaking", 0.7, "raise_confidence"),
            "raise_repeats": at("Glass Breaking", 2, "raise_repeats"),
        }
    )


_RULES = f"""(SELECT * REPLACE (category = 'Machinery Fault' AS require_model_agreement, CASE category WHEN 'Glass Breaking' THEN 0.7 ELSE raise_confidence END AS raise_confidence,
    CASE category WHEN 'Glass Breaking' THEN 2 ELSE raise_repeats END AS raise_repeats) FROM {rule_sql()} WHERE category <> 'Animal Sound')"""
_BASE = f"""(SELECT e.*, coalesce(q.critical, false) AS critical, coalesce(q.alert, false) AS alert, coalesce(q.severity, 'Informational') AS sev, coalesce(q.min_confidence, 0.6) AS mc,
    coalesce(q.top_two_margin, 0.15) AS tm, coalesce(q.consecutive_detections, 1) AS cd, coalesce(q.min_quality, 'Poor') AS mq, coalesce(q.recommended_action, '') AS action, coalesce(q.require_model_agreement, false) AS agree,
    q.raise_confidence AS rc, q.raise_repeats AS rr, q.noise_limit_dbfs AS nl, q.noise_severity AS ns, q.noise_alert AS na, q.noise_action AS nx FROM (
    SELECT *, gtm_confidence IS NOT NULL AND gtm_class = python_class AS m, python_confidence < 0.35 OR quality_grade = 'Unusable' AS u,
    CASE WHEN python_confidence < 0.35 OR quality_grade = 'Unusable' THEN 'Unknown' ELSE python_class END AS final_class, k % 4 AS rep, event_id % 3 + 1 AS nw,
    CASE WHEN event_id % 10 <> 0 THEN -(k % 60) END AS db FROM {{scored_events}}) e LEFT JOIN {_RULES} q ON q.category = e.final_class)"""
_STEP = f"""(SELECT *, final_class = 'Background Noise' AND coalesce(db > nl, false) AS noisy, CASE WHEN u THEN 0 ELSE rep END AS r, {rank_sql("quality_grade", GRADES)} AS g, {rank_sql("mq", GRADES)} AS mg FROM {_BASE})"""
_ALERT = f"""(SELECT *, CASE WHEN u OR NOT CASE WHEN noisy THEN na ELSE alert END THEN 'No alert' WHEN python_confidence >= mc AND python_margin >= tm AND r >= least(cd, nw) AND g <= mg AND (m OR NOT agree) THEN 'Alert generated' ELSE 'Not confirmed' END AS alert_status FROM {_STEP})"""
_REASON = f"""(SELECT *, list_filter([CASE WHEN gtm_confidence IS NULL THEN '{R_NO_SECOND}' WHEN NOT m THEN '{R_DISAGREE}' END, CASE WHEN python_confidence < 0.5 THEN '{R_LOW}' END, CASE WHEN g >= 2 THEN '{R_POOR}' END,
    CASE WHEN python_margin < 0.1 THEN '{R_SIMILAR}' END, CASE WHEN event_id % 8 = 0 THEN '{R_OVERLAP}' END, CASE WHEN u THEN '{R_UNSUPPORTED}' END, CASE WHEN alert_status = 'Not confirmed' THEN '{R_FALSE}' END,
    CASE WHEN critical AND NOT u AND NOT m THEN '{R_CRITICAL}' END], lambda x: x IS NOT NULL) AS reasons FROM {_ALERT})"""
_FAILED = """CASE WHEN alert_status <> 'Not confirmed' THEN '' ELSE array_to_string(list_filter([CASE WHEN agree AND NOT m THEN 'agreement' END, CASE WHEN python_confidence < mc THEN 'confidence' END,
    CASE WHEN python_margin < tm THEN 'margin' END, CASE WHEN g > mg THEN 'quality' END, CASE WHEN r < least(cd, nw) THEN 'repeats' END], lambda x: x IS NOT NULL), ',') END"""
_DECISION = f"""SELECT event_id, final_class, alert_status, CASE WHEN alert_status = 'Alert generated' AND coalesce(python_confidence >= rc AND r >= rr, false) THEN 'Critical' WHEN noisy THEN ns ELSE sev END AS severity, array_to_string(reasons, '; ') AS reasons,
    CASE WHEN noisy THEN nx ELSE action END AS action, {_FAILED} AS failed,
    CASE WHEN python_confidence >= greatest(0.8, mc) AND python_margin >= 0.1 AND m AND gtm_confidence >= 0.5 AND abs(python_confidence - gtm_confidence) <= 0.3 THEN 'High' WHEN python_confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level,
    CASE WHEN alert_status = 'Alert generated' THEN 'Alert Generated' WHEN gtm_confidence IS NULL OR NOT m OR python_confidence < 0.5 OR g >= 2 OR python_margin < 0.1 OR event_id % 8 = 0 THEN 'Uncertain' WHEN len(reasons) > 0 THEN 'Manual Review' ELSE 'Classified' END AS status FROM {_REASON}"""


@query("sc13_decision", _DECISION)
def _sc13(v: Views) -> DataFrame:
    found = decide(_decision_input(v), _decision_rules(v.spark))
    failed = F.array_join(F.array_sort(F.map_keys(F.map_filter("conditions", lambda k, ok: ~ok))), ",")
    return found.select(
        "event_id", "final_class", "alert_status", "severity", F.array_join("review_reasons", "; ").alias("reasons"), F.col("recommended_action").alias("action"),
        F.when(F.col("alert_status") == "Not confirmed", failed).otherwise("").alias("failed"), "confidence_level", "status",
    )


@query(
    "decision_overview_by_class",
    f"SELECT final_class, alert_status, status, count(*) AS n, count(*) FILTER (severity = 'Critical') AS critical FROM ({_DECISION}) GROUP BY final_class, alert_status, status",
)
def decision_overview(v: Views) -> DataFrame:
    """The flagship: decide on every event, then count by class, alert and status."""
    found = decide(_decision_input(v), _decision_rules(v.spark))
    return found.groupBy("final_class", "alert_status", "status").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "Critical").alias("critical"))


@query(
    "sc14_overlapping_classes",
    "SELECT window_id, array_to_string(list_sort(list(CAST(class_no AS VARCHAR)) FILTER (p >= 0.11)), ',') AS overlaps FROM {scores} GROUP BY window_id HAVING count(*) FILTER (p >= 0.11) >= 2",
)
def _sc14(v: Views) -> DataFrame:
    w = v.scores.groupBy("window_id").agg(F.array(F.collect_list(F.struct(F.col("class_no").cast("string").alias("class"), "p"))).alias("windows"))
    found = w.select("window_id", overlapping_classes("windows", 0.11).alias("o"))
    return found.filter(F.size("o") > 0).select("window_id", F.array_join("o", ",").alias("overlaps"))


@query(
    "sc7_levels",
    "SELECT vec_id, round(10 * log10(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding) + 1e-10), 4) AS dbfs FROM embeddings",
)
def _sc7(v: Views) -> DataFrame:
    return v.embeddings.select("vec_id", F.round(rms_dbfs("embedding"), 4).alias("dbfs"))


def rms_dbfs(samples: str) -> Column:
    """Level of an array of samples in dB below full scale; null for an empty array."""
    total = F.aggregate(F.col(samples), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, 10 * F.log10(total / F.size(samples) + 1e-10))


@query(
    "io8_feature_health",
    "SELECT label, count(*) AS n, CAST(sum(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x)))) AS BIGINT) AS bad FROM embeddings GROUP BY label",
)
def _io8(v: Views) -> DataFrame:
    bad = F.size(F.filter("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return v.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.sum(bad).alias("bad"))


@query(
    "io2_rules_from_json",
    """SELECT 'rule ' || c_custkey AS category, CASE c_custkey % 3 WHEN 0 THEN 'Informational' ELSE 'High' END AS severity, c_custkey % 2 = 0 AS alert, CASE c_custkey % 5 WHEN 0 THEN 0.6 ELSE (c_custkey % 100) / 100 END AS min_confidence,
    c_custkey % 7 <> 1 AS enabled, CASE c_custkey % 4 WHEN 0 THEN coalesce(CASE c_custkey % 8 WHEN 0 THEN 3 END, 1) END AS raise_repeats, CASE c_custkey % 11 WHEN 2 THEN 'Medium' END AS noise_severity
    FROM customer WHERE c_custkey % 13 <> 0""",
)
def _io2(v: Views) -> DataFrame:
    """A JSON text per customer: keys left out, comments, nested parts, rules without a category."""
    n = F.col("c_custkey")
    text = lambda when, *parts: F.when(when, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))).otherwise("")
    value = F.concat(
        F.lit('[{"_comment": "a {note}", "critical": false'),
        text(n % 13 != 0, ', "category": "rule ', n.cast("string"), '"'),
        text(n % 3 != 0, ', "severity": "High"'),
        text(n % 2 == 0, ', "alert": true'),
        text(n % 5 != 0, ', "min_confidence": ', ((n % 100) / 100).cast("string")),
        text(n % 7 == 1, ', "enabled": false'),
        text(n % 8 == 0, ', "raise_to_critical": {"min_confidence": 0.9, "consecutive_detections": 3}'),
        text(n % 8 == 4, ', "raise_to_critical": {"min_confidence": 0.9}'),
        text(n % 11 == 2, ', "noise_limit_dbfs": -20, "above_noise_limit": {"severity": "Medium", "alert": true}'),
        F.lit(', "manual_review": "x"}]'),
    )
    rules = parse_rules(v.customer.select(value.alias("value")))
    return rules.select("category", "severity", "alert", "min_confidence", "enabled", "raise_repeats", "noise_severity")
