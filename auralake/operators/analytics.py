"""Dashboard aggregates over sound events and alerts: one pass, conditional aggregation, zero-filled dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions.rules import GRADES, rule_sql, rule_table
from auralake.operators.events import _EVENTS, CLOSED_STATUSES, local_day, with_effective
from auralake.operators.ordering import settled, small
from auralake.plans.registry import Views, query

_rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))


def overview(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of key figures; rates are null without a base."""
    e = with_effective(events)
    one = e.agg(
        F.count("*").alias("total"),
        F.round(F.avg("python_confidence"), 6).alias("mean_confidence"),
        F.count_if(F.col("gtm_class") != "").alias("compared"),
        F.count_if((F.col("gtm_class") != "") & ~F.col("class_match")).alias("disagreements"),
        F.count_if(F.col("quality_grade").isin("Poor", "Unusable")).alias("poor"),
        F.count_if(F.col("effective_severity") == "Critical").alias("critical"),
        F.count_if(F.col("review_required") & ~F.col("status").isin(*CLOSED_STATUSES)).alias("waiting"),
    )
    two = alerts.agg(
        F.count_if("critical").alias("critical_alerts"),
        F.count_if(~F.col("status").isin("Resolved", "Dismissed")).alias("open_alerts"),
    )
    return one.join(F.broadcast(two)).withColumn("disagreement_rate", _rate("disagreements", "compared"))  # one row each


def by_category(events: DataFrame) -> DataFrame:
    return with_effective(events).groupBy("effective_class").agg(F.count("*").alias("n"))


def daily(events: DataFrame, first: str, days: int, zone: str = "UTC") -> DataFrame:
    """(day, events, critical) for `days` days from `first`; days without events count 0."""
    spark = events.sparkSession
    calendar = spark.range(days).select(F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias("day"))
    per = (
        with_effective(events)
        .groupBy(local_day("created_at", zone).alias("day"))
        .agg(F.count("*").alias("events"), F.count_if(F.col("effective_severity") == "Critical").alias("critical"))
    )
    return calendar.join(per, "day", "left").fillna(0, ["events", "critical"])


def critical_frequency(events: DataFrame, alerts: DataFrame, rules: DataFrame) -> DataFrame:
    classes = rules.filter("critical").select("category")
    e = with_effective(events).groupBy(F.col("effective_class").alias("category")).agg(F.count("*").alias("events"))
    a = alerts.groupBy("category").agg(F.count("*").alias("alerts"))
    return small(classes).join(e, "category", "left").join(a, "category", "left").fillna(0, ["events", "alerts"])


def confidence_histogram(events: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, first, second): counts per confidence bin of both models; 1.0 falls in the last bin, nulls are skipped."""
    b = lambda c: F.when(F.col(c).isNotNull(), F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))).cast("int")
    both = F.array(F.struct(b("python_confidence").alias("bin"), F.lit(1).alias("f"), F.lit(0).alias("s")), F.struct(b("gtm_confidence").alias("bin"), F.lit(0).alias("f"), F.lit(1).alias("s")))
    per = events.select(F.explode(both).alias("x")).filter("x.bin IS NOT NULL").groupBy("x.bin").agg(F.sum("x.f").alias("first"), F.sum("x.s").alias("second"))
    scale = events.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return scale.join(per, "bin", "left").fillna(0, ["first", "second"])


def quality_distribution(events: DataFrame) -> DataFrame:
    grades = events.sparkSession.createDataFrame([(g,) for g in GRADES], "quality_grade string")
    return grades.join(events.groupBy("quality_grade").agg(F.count("*").alias("n")), "quality_grade", "left").fillna(0, ["n"])


def disagreement_by_class(events: DataFrame) -> DataFrame:
    per = events.filter("gtm_class <> ''").groupBy("python_class").agg(F.count("*").alias("compared"), F.count_if(~F.col("class_match")).alias("disagreements"))
    return per.withColumn("rate", F.col("disagreements") / F.col("compared"))


def errors_by_class(events: DataFrame, alerts: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Per class: confirmed, fp, fn (reviews), py_fp, py_fn, gtm_fp, gtm_fn (reference labels), dismissed (alerts).

    Every event gives its few (class, measure) pairs, which are counted map-side and pivoted.
    Of classes, those without any have zeros; without the list, only classes that occur are told.
    """
    reviewed = F.col("reviewed_class") != ""
    wrong = reviewed & (F.col("reviewed_class") != F.col("final_class"))
    known = F.col("reference_class") != ""
    pair = lambda c, m, when: F.when(when, F.struct(F.col(c).alias("class_name"), F.lit(m).alias("measure")))
    py_wrong = known & (F.col("python_class") != F.col("reference_class"))
    gtm_wrong = known & (F.col("gtm_class") != "") & (F.col("gtm_class") != F.col("reference_class"))
    pairs = F.array_compact(
        F.array(
            pair("final_class", "confirmed", reviewed & ~wrong),
            pair("final_class", "fp", wrong),
            pair("reviewed_class", "fn", wrong),
            pair("python_class", "py_fp", py_wrong),
            pair("reference_class", "py_fn", py_wrong),
            pair("gtm_class", "gtm_fp", gtm_wrong),
            pair("reference_class", "gtm_fn", gtm_wrong),
        )
    )
    rows = events.select(F.explode(pairs).alias("x")).select("x.*")
    rows = rows.unionByName(alerts.filter("status = 'Dismissed'").select(F.col("category").alias("class_name"), F.lit("dismissed").alias("measure")))
    names = ["confirmed", "fp", "fn", "py_fp", "py_fn", "gtm_fp", "gtm_fn", "dismissed"]
    counted = rows.groupBy("class_name").pivot("measure", names).count()
    if classes is not None:
        counted = events.sparkSession.createDataFrame([(c,) for c in classes], "class_name string").join(counted, "class_name", "full_outer")
    return counted.fillna(0, names)


def reference_accuracy(events: DataFrame) -> DataFrame:
    """(model, n, correct, accuracy) of both models against reference labels; accuracy is null where a model has none."""
    known = events.filter("reference_class <> ''")
    models = F.array(
        F.struct(F.lit("first").alias("model"), F.lit(True).alias("scored"), (F.col("python_class") == F.col("reference_class")).alias("hit")),
        F.struct(F.lit("second").alias("model"), (F.col("gtm_class") != "").alias("scored"), (F.col("gtm_class") == F.col("reference_class")).alias("hit")),
    )
    per = known.select(F.explode(models).alias("m")).groupBy("m.model").agg(F.count_if("m.scored").alias("n"), F.count_if(F.col("m.scored") & F.col("m.hit")).alias("correct"))
    every = events.sparkSession.createDataFrame([("first",), ("second",)], "model string").join(per, "model", "left").fillna(0)
    return every.withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")))


def exact_median(rows: DataFrame, key: str, value: str, name: str, buckets: int = 1_024) -> DataFrame:
    """(key, name): the exact median per key; null values do not count, and a key without others has no row.

    Rank selection: values are counted, and for the one or two middle ranks of a
    key the counts of equal ranges tell the range that holds the rank; only that
    range, between its own least and largest value, is cut again, until it is one
    value.  No key's values are sorted, and a round moves `buckets` rows a key.
    """
    counted = settled(rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    middle = F.array_distinct(F.array(F.floor((F.col("_all") + 1) / 2), F.ceil((F.col("_all") + 1) / 2)))
    sought = counted.groupBy(key).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    sought = settled(sought.select(key, F.explode(middle).alias("_rank"), F.lit(0).cast("long").alias("_before"), "_low", "_high"))
    order = Window.partitionBy(key, "_rank").orderBy("_bucket")
    while not sought.filter("_low < _high").isEmpty():
        inside = counted.join(small(sought), key).filter("_v BETWEEN _low AND _high")
        share = (F.col("_v") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
        bucket = F.coalesce(F.least(F.floor(share * buckets), F.lit(buckets - 1)), F.lit(0))
        per = inside.withColumn("_bucket", bucket).groupBy(key, "_rank", "_before", "_bucket").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.col("_before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        held = per.withColumn("_upto", upto).filter("_upto >= _rank AND _upto - _n < _rank")
        sought = settled(held.select(key, "_rank", (F.col("_upto") - F.col("_n")).alias("_before"), "_low", "_high"))
    return sought.groupBy(key).agg(F.avg("_low").alias(name))


def alert_response(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Per severity: alerts, handled, median minutes to the first action of a person, auto-escalated, dismissed, open."""
    first = actions.groupBy("alert_id").agg(
        F.min(F.when(F.col("username").isNotNull(), F.col("created_at"))).alias("handled_at"),
        F.max(F.coalesce(F.col("username").isNull() & (F.col("action") == "escalate"), F.lit(False))).alias("auto"),
    )
    minutes = (F.unix_timestamp("handled_at") - F.unix_timestamp("created_at")) / 60
    joined = alerts.join(first, "alert_id", "left").withColumn("minutes", minutes)
    counts = joined.groupBy("severity").agg(
        F.count("*").alias("alerts"),
        F.count("handled_at").alias("handled"),
        F.count_if("auto").alias("auto_escalated"),
        F.count_if(F.col("status") == "Dismissed").alias("dismissed"),
        F.count_if(~F.col("status").isin("Resolved", "Dismissed")).alias("open"),
    )
    return counts.join(exact_median(joined, "severity", "minutes", "median_minutes"), "severity", "left")


@query(
    "a1_overview",
    f"""SELECT total, mean_confidence, compared, disagreements, poor, critical, waiting, critical_alerts, open_alerts, CASE WHEN compared > 0 THEN disagreements / compared END AS disagreement_rate FROM (
    SELECT count(*) AS total, round(avg(python_confidence), 6) AS mean_confidence, count(*) FILTER (gtm_class <> '') AS compared, count(*) FILTER (gtm_class <> '' AND NOT class_match) AS disagreements,
    count(*) FILTER (quality_grade IN ('Poor', 'Unusable')) AS poor, count(*) FILTER (effective_severity = 'Critical') AS critical,
    count(*) FILTER (review_required AND status NOT IN ('Reviewed', 'Closed')) AS waiting FROM {_EVENTS}), (
    SELECT count(*) FILTER (critical) AS critical_alerts, count(*) FILTER (status NOT IN ('Resolved', 'Dismissed')) AS open_alerts FROM {{alerts}})""",
)
def _a1(v: Views) -> DataFrame:
    return overview(v.sound_events, v.alerts)


@query("a2_by_class", f"SELECT effective_class, count(*) AS n FROM {_EVENTS} GROUP BY effective_class")
def _a2(v: Views) -> DataFrame:
    return by_category(v.sound_events)


@query(
    "a3_daily_trend",
    f"""SELECT d.day, coalesce(n, 0) AS events, coalesce(c, 0) AS critical FROM (SELECT CAST(DATE '2023-12-30' + CAST(i AS INTEGER) AS DATE) AS day FROM range(60) t(i)) d LEFT JOIN (
    SELECT CAST(created_at AS DATE) AS day, count(*) AS n, count(*) FILTER (effective_severity = 'Critical') AS c FROM {_EVENTS} GROUP BY 1) e ON e.day = d.day""",
)
def _a3(v: Views) -> DataFrame:
    return daily(v.sound_events, "2023-12-30", 60)


@query(
    "a4_critical_frequency",
    f"""SELECT category, coalesce(e.n, 0) AS events, coalesce(a.n, 0) AS alerts FROM {rule_sql()} LEFT JOIN (SELECT effective_class, count(*) AS n FROM {_EVENTS} GROUP BY 1) e ON effective_class = category
    LEFT JOIN (SELECT category AS c, count(*) AS n FROM {{alerts}} GROUP BY 1) a ON c = category WHERE critical""",
)
def _a4(v: Views) -> DataFrame:
    return critical_frequency(v.sound_events, v.alerts, rule_table(v.spark))


@query(
    "a5_confidence_histogram",
    """SELECT CAST(i AS INTEGER) AS bin, coalesce(f, 0) AS first, coalesce(s, 0) AS second FROM range(10) t(i)
    LEFT JOIN (SELECT least(floor(python_confidence * 10), 9) AS b, count(*) AS f FROM {sound_events} GROUP BY 1) x ON x.b = i
    LEFT JOIN (SELECT least(floor(gtm_confidence * 10), 9) AS b, count(*) AS s FROM {sound_events} WHERE gtm_confidence IS NOT NULL GROUP BY 1) y ON y.b = i""",
)
def _a5(v: Views) -> DataFrame:
    return confidence_histogram(v.sound_events)


@query(
    "a6_quality_distribution",
    "SELECT g AS quality_grade, count(event_id) AS n FROM (VALUES ('Good'), ('Acceptable'), ('Poor'), ('Unusable')) AS t(g) LEFT JOIN {sound_events} e ON e.quality_grade = g GROUP BY g",
)
def _a6(v: Views) -> DataFrame:
    return quality_distribution(v.sound_events)


@query(
    "a7_disagreement_by_class",
    "SELECT python_class, count(*) AS compared, count(*) FILTER (NOT class_match) AS disagreements, count(*) FILTER (NOT class_match) / count(*) AS rate FROM {sound_events} WHERE gtm_class <> '' GROUP BY python_class",
)
def _a7(v: Views) -> DataFrame:
    return disagreement_by_class(v.sound_events)


_M = "SELECT {c} AS class_name, '{m}' AS measure FROM {{sound_events}} WHERE {w}"


@query(
    "a8_errors_by_class",
    "SELECT class_name, "
    + ", ".join(f"count(*) FILTER (measure = '{m}') AS {m}" for m in ("confirmed", "fp", "fn", "py_fp", "py_fn", "gtm_fp", "gtm_fn", "dismissed"))
    + " FROM (SELECT unnest(['Panic Scream', 'Gunshot', 'Aggression']) AS class_name, NULL AS measure UNION ALL "
    + " UNION ALL ".join(
        _M.format(c=c, m=m, w=w)
        for c, m, w in (
            ("final_class", "confirmed", "reviewed_class <> '' AND reviewed_class = final_class"),
            ("final_class", "fp", "reviewed_class <> '' AND reviewed_class <> final_class"),
            ("reviewed_class", "fn", "reviewed_class <> '' AND reviewed_class <> final_class"),
            ("python_class", "py_fp", "reference_class <> '' AND python_class <> reference_class"),
            ("reference_class", "py_fn", "reference_class <> '' AND python_class <> reference_class"),
            ("gtm_class", "gtm_fp", "reference_class <> '' AND gtm_class <> '' AND gtm_class <> reference_class"),
            ("reference_class", "gtm_fn", "reference_class <> '' AND gtm_class <> '' AND gtm_class <> reference_class"),
        )
    ).replace("{{", "{").replace("}}", "}")
    + " UNION ALL SELECT category, 'dismissed' FROM {alerts} WHERE status = 'Dismissed') GROUP BY class_name",
)
def _a8(v: Views) -> DataFrame:
    return errors_by_class(v.sound_events, v.alerts, ["Panic Scream", "Gunshot", "Aggression"])


@query(
    "a9_reference_accuracy",
    """SELECT model, count(*) AS n, count(*) FILTER (hit) AS correct, count(*) FILTER (hit) / count(*) AS accuracy FROM (
    SELECT 'first' AS model, python_class = reference_class AS hit FROM {sound_events} WHERE reference_class <> '' UNION ALL
    SELECT 'second', gtm_class = reference_class FROM {sound_events} WHERE reference_class <> '' AND gtm_class <> '') GROUP BY model""",
)
def _a9(v: Views) -> DataFrame:
    return reference_accuracy(v.sound_events)


@query(
    "a10_alert_response",
    """SELECT severity, count(*) AS alerts, count(handled_at) AS handled, median((epoch(handled_at) - epoch(a.created_at)) / 60) AS median_minutes,
    count(*) FILTER (auto) AS auto_escalated, count(*) FILTER (status = 'Dismissed') AS dismissed, count(*) FILTER (status NOT IN ('Resolved', 'Dismissed')) AS open
    FROM {alerts} a LEFT JOIN (SELECT alert_id, min(created_at) FILTER (username IS NOT NULL) AS handled_at, bool_or(username IS NULL AND action = 'escalate') AS auto FROM {actions} GROUP BY alert_id) f ON f.alert_id = a.alert_id GROUP BY severity""",
)
def _a10(v: Views) -> DataFrame:
    return alert_response(v.alerts, v.actions)


