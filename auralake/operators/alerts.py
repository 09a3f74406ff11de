"""Alert life cycle, reviews, escalation, notices and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.functions.rules import rule_sql, rule_table, with_rule
from auralake.operators.ordering import settled, small
from auralake.plans.registry import Views, query

#: action: statuses it may start from, status afterwards.  Fixed values.
TRANSITIONS = {
    "acknowledge": (("Active", "Escalated"), "Acknowledged"),
    "escalate": (("Active", "Acknowledged"), "Escalated"),
    "dismiss": (("Active", "Acknowledged", "Escalated"), "Dismissed"),
    "resolve": (("Acknowledged", "Escalated"), "Resolved"),
}


def replay_actions(actions: DataFrame) -> DataFrame:
    """(alert_id, status, refused): the state machine over each alert's actions in order, from Active.

    An action that may not start from the current status is refused, and so is a
    dismissal or a note without text.  The fold runs inside the engine over the
    sorted actions of one alert, whose number is small.
    """
    ordered = actions.groupBy("alert_id").agg(
        F.sort_array(F.collect_list(F.struct("created_at", "action_id", "action", "note"))).alias("steps")
    )
    cases = " ".join(
        f"WHEN x.action = '{a}' AND s.status IN ({', '.join(repr(f) for f in before)}) {'AND x.note <> {}'.format(repr('')) if a == 'dismiss' else ''} THEN '{after}'"
        for a, (before, after) in TRANSITIONS.items()
    )
    fold = F.expr(
        f"""aggregate(transform(steps, x -> named_struct('action', x.action, 'note', trim(coalesce(x.note, '')))),
        named_struct('status', 'Active', 'refused', 0), (s, x) -> named_struct(
        'status', CASE {cases} ELSE s.status END,
        'refused', s.refused + CASE WHEN x.action = 'note' THEN IF(x.note = '', 1, 0) WHEN (CASE {cases} END) IS NULL THEN 1 ELSE 0 END))"""
    )
    return ordered.withColumn("end", fold).select("alert_id", "end.status", "end.refused")


def replay_reviews(reviews: DataFrame, rules: DataFrame) -> DataFrame:
    """(event_id, reviewed_class, reviewed_severity, reviewed_action, status): the latest decision and the latest status of each event.

    reviews: event_id, step, kind (confirm, correct, close, reopen, comment),
    final_class, new_class, severity, action.  A correction to the automatic
    class is a confirmation; a correction without severity or action takes those
    of its class's rule.
    """
    changed = (F.col("kind") == "correct") & (F.col("new_class") != F.col("final_class"))
    named = with_rule(reviews, rules, "new_class")
    given = lambda c, rule: F.coalesce(F.nullif(F.col(c), F.lit("")), F.when(changed, F.col(rule)), F.lit(""))
    decision = F.col("kind").isin("confirm", "correct")
    decided = named.withColumns(
        {
            "class": F.when(decision, F.when(changed, F.col("new_class")).otherwise(F.col("final_class"))),
            "sev": F.when(decision, given("severity", "rule_severity")),
            "act": F.when(decision, given("action", "rule_recommended_action")),
            "state": F.when(decision, "Reviewed").when(F.col("kind") == "close", "Closed").when(F.col("kind") == "reopen", "Manual Review"),
        }
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step")))
    return decided.groupBy("event_id").agg(last("class").alias("reviewed_class"), last("sev").alias("reviewed_severity"), last("act").alias("reviewed_action"), last("state").alias("status"))


def overdue(alerts: DataFrame, now: str) -> DataFrame:
    """Active alerts older than their rule's minutes."""
    age = F.to_timestamp(F.lit(now)).cast("long") - F.col("created_at").cast("long")
    return alerts.filter((F.col("status") == "Active") & F.col("escalate_after_minutes").isNotNull() & (age >= F.col("escalate_after_minutes") * 60))


def escalate(alerts: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The alerts after escalation, and a log row per escalated alert."""
    ids = overdue(alerts, now).select("alert_id", F.lit(True).alias("late"))
    after = alerts.join(ids, "alert_id", "left").withColumn("status", F.when(F.col("late"), "Escalated").otherwise(F.col("status"))).drop("late")
    log = ids.select("alert_id", F.to_timestamp(F.lit(now)).alias("created_at"), F.lit("escalate").alias("action"), F.lit(None).cast("string").alias("username"))
    return after, log


def tab_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(F.col("status").isin("Active", "Escalated")).alias("attention"),
        F.count_if(F.col("status") == "Acknowledged").alias("acknowledged"),
        F.count_if(F.col("status").isin("Resolved", "Dismissed")).alias("closed"),
        F.count("*").alias("everything"),
    )


def detections(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Detections per alert: one, plus every note that no person wrote."""
    notes = actions.filter("action = 'note' AND username IS NULL").groupBy("alert_id").agg(F.count("*").alias("n"))
    return alerts.select("alert_id").join(notes, "alert_id", "left").select("alert_id", (F.coalesce("n", F.lit(0)) + 1).alias("detections"))


def upsert_notices(notices: DataFrame, raised: DataFrame) -> DataFrame:
    """Notices after new ones are raised: an open notice of the same kind and key keeps its first_seen and the larger count, and takes the newest message.

    notices: kind, key, message, count, first_seen, last_seen, acknowledged_at;
    raised: kind, key, message, count, seen.  Acknowledged notices are untouched.
    Messages are cut at 300 letters, of equal times the last in text order counts.
    """
    none = F.lit(None).cast("timestamp").alias("acknowledged_at")
    names = ["kind", "key", "message", "count", "first_seen", "last_seen", "acknowledged_at"]
    fresh = raised.select("kind", "key", F.left("message", F.lit(300)).alias("message"), "count", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), none)
    both = notices.filter("acknowledged_at IS NULL").select(names).unionByName(fresh).groupBy("kind", "key").agg(
        F.max_by("message", F.struct("last_seen", "message")).alias("message"), F.max("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), none
    )
    return notices.filter("acknowledged_at IS NOT NULL").select(names).unionByName(both.select(names))


def _retention_flags(records: DataFrame, alerts: DataFrame, now_s: int, audio_days: int, event_days: int) -> DataFrame:
    pending = alerts.filter("status IN ('Active', 'Acknowledged', 'Escalated')").select(F.col("event_id").alias("record_id"), F.lit(True).alias("open")).distinct()
    needed = F.coalesce(F.col("review_required") & ~F.col("status").isin("Reviewed", "Closed"), F.lit(False)) | F.coalesce("open", F.lit(False))
    age = F.lit(now_s) - F.col("uploaded_s")
    old = age > event_days * 86400
    action = (
        F.when(old & needed, "kept")
        .when(old, "event")
        .when((age > audio_days * 86400) & (F.col("stored_file") != "") & ~needed, "audio")
        .otherwise("none")
    )
    return records.join(pending, "record_id", "left").withColumn("retention", action).drop("open")


def retention_plan(records: DataFrame, alerts: DataFrame, now_s: int, audio_days: int, event_days: int) -> DataFrame:
    """One row: audio files to delete, event records to delete, old records kept because still needed."""
    flags = _retention_flags(records, alerts, now_s, audio_days, event_days)
    return flags.agg(*(F.count_if(F.col("retention") == k).alias(n) for k, n in (("audio", "audio_files"), ("event", "event_records"), ("kept", "kept_open"))))


def apply_retention(records: DataFrame, alerts: DataFrame, now_s: int, audio_days: int, event_days: int, events: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """(records, alerts, events where given) that stay: files past the audio limit are blanked; an event and its alerts go with their record.

    events: event_id, record_id.  The ids that go are joined by key, and
    broadcast only if they are few.
    """
    flags = settled(_retention_flags(records, alerts, now_s, audio_days, event_days))
    gone = small(settled(flags.filter("retention = 'event'").select(F.col("record_id").alias("event_id"))))
    stay = flags.filter("retention <> 'event'").withColumn("stored_file", F.when(F.col("retention") == "audio", "").otherwise(F.col("stored_file"))).drop("retention")
    left = (stay, alerts.join(gone, "event_id", "left_anti"))
    return left if events is None else (*left, events.join(gone.withColumnRenamed("event_id", "record_id"), "record_id", "left_anti"))


@query(
    "w13_alert_replay",
    """WITH RECURSIVE steps AS (SELECT alert_id, action, trim(coalesce(note, '')) AS note, row_number() OVER (PARTITION BY alert_id ORDER BY created_at, action_id, action, note) AS n FROM {actions}),
    run AS (SELECT alert_id, 0 AS n, 'Active' AS status, 0 AS refused FROM (SELECT DISTINCT alert_id FROM {actions}) UNION ALL
    SELECT r.alert_id, s.n, coalesce(after, r.status), r.refused + CASE WHEN s.action = 'note' THEN CASE WHEN s.note = '' THEN 1 ELSE 0 END WHEN after IS NULL THEN 1 ELSE 0 END
    FROM run r JOIN steps s ON s.alert_id = r.alert_id AND s.n = CAST(r.n + 1 AS BIGINT), LATERAL (SELECT CASE
    WHEN s.action = 'acknowledge' AND r.status IN ('Active', 'Escalated') THEN 'Acknowledged' WHEN s.action = 'escalate' AND r.status IN ('Active', 'Acknowledged') THEN 'Escalated'
    WHEN s.action = 'dismiss' AND s.note <> '' AND r.status IN ('Active', 'Acknowledged', 'Escalated') THEN 'Dismissed' WHEN s.action = 'resolve' AND r.status IN ('Acknowledged', 'Escalated') THEN 'Resolved' END AS after))
    SELECT alert_id, max_by(status, n) AS status, CAST(max_by(refused, n) AS INTEGER) AS refused FROM run GROUP BY alert_id""",
)
def _w13(v: Views) -> DataFrame:
    return replay_actions(v.actions)


_REVIEWS = """(SELECT event_id % 2000 AS event_id, event_id AS step, CASE (event_id // 2000) % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'correct' WHEN 2 THEN 'comment' WHEN 3 THEN 'close' ELSE 'reopen' END AS kind,
    final_class, python_class AS new_class, reviewed_severity AS severity, reviewed_action AS action FROM {sound_events})"""


@query(
    "w14_review_replay",
    f"""SELECT event_id, max_by(cls, step) FILTER (cls IS NOT NULL) AS reviewed_class, max_by(sev, step) FILTER (sev IS NOT NULL) AS reviewed_severity, max_by(act, step) FILTER (act IS NOT NULL) AS reviewed_action, max_by(state, step) FILTER (state IS NOT NULL) AS status FROM (
    SELECT r.event_id, step, CASE WHEN kind IN ('confirm', 'correct') THEN CASE WHEN kind = 'correct' THEN new_class ELSE final_class END END AS cls,
    CASE WHEN kind IN ('confirm', 'correct') THEN coalesce(nullif(r.severity, ''), CASE WHEN kind = 'correct' AND new_class <> final_class THEN coalesce(q.severity, 'Informational') END, '') END AS sev,
    CASE WHEN kind IN ('confirm', 'correct') THEN coalesce(nullif(r.action, ''), CASE WHEN kind = 'correct' AND new_class <> final_class THEN coalesce(q.recommended_action, '') END, '') END AS act,
    CASE WHEN kind IN ('confirm', 'correct') THEN 'Reviewed' WHEN kind = 'close' THEN 'Closed' WHEN kind = 'reopen' THEN 'Manual Review' END AS state
    FROM {_REVIEWS} r LEFT JOIN {rule_sql()} q ON q.category = new_class) GROUP BY event_id""",
)
def _w14(v: Views) -> DataFrame:
    step = F.floor(F.col("event_id") / 2000) % 5
    kind = F.when(step == 0, "confirm").when(step == 1, "correct").when(step == 2, "comment").when(step == 3, "close").otherwise("reopen")
    reviews = v.sound_events.select(
        (F.col("event_id") % 2000).alias("event_id"), F.col("event_id").alias("step"), kind.alias("kind"), "final_class",
        F.col("python_class").alias("new_class"), F.col("reviewed_severity").alias("severity"), F.col("reviewed_action").alias("action"),
    )
    return replay_reviews(reviews, rule_table(v.spark))


@query(
    "st3_escalation_batch",
    """SELECT alert_id, CASE WHEN status = 'Active' AND escalate_after_minutes IS NOT NULL AND epoch(TIMESTAMP '1998-01-01') - epoch(created_at) >= escalate_after_minutes * 60 THEN 'Escalated' ELSE status END AS status FROM {alerts}""",
)
def _st3(v: Views) -> DataFrame:
    return escalate(v.alerts, "1998-01-01 00:00:00")[0].select("alert_id", "status")


@query(
    "a35_alert_tabs",
    "SELECT count(*) FILTER (status IN ('Active', 'Escalated')) AS attention, count(*) FILTER (status = 'Acknowledged') AS acknowledged, count(*) FILTER (status IN ('Resolved', 'Dismissed')) AS closed, count(*) AS everything FROM {alerts}",
)
def _a35(v: Views) -> DataFrame:
    return tab_counts(v.alerts)


@query(
    "a35_detections_per_alert",
    "SELECT alert_id, 1 + (SELECT count(*) FROM {actions} x WHERE x.alert_id = a.alert_id AND action = 'note' AND username IS NULL) AS detections FROM {alerts} a",
)
def _a35b(v: Views) -> DataFrame:
    return detections(v.alerts, v.actions)


_NOTICES = "SELECT 'login' AS kind, username AS key, 'seen ' || id || repeat('.', CAST(id % 400 AS INT)) AS message, id % 9 AS count, created_at AS seen, id % 3 = 0 AS done FROM {audit} WHERE action = 'login_failed' AND username <> ''"


@query(
    "a33_notice_upsert",
    f"""WITH rows AS (SELECT * REPLACE (left(message, 300) AS message) FROM ({_NOTICES})), old AS (SELECT kind, key, arg_max(message, (seen, message)) AS message, max(count) AS count, min(seen) AS first_seen, max(seen) AS last_seen,
    CASE WHEN CAST(substr(key, 5) AS BIGINT) % 2 = 0 THEN max(seen) END AS acknowledged_at FROM rows WHERE done GROUP BY kind, key)
    SELECT * FROM old WHERE acknowledged_at IS NOT NULL UNION ALL SELECT kind, key, arg_max(message, (last_seen, message)), max(count), min(first_seen), max(last_seen), NULL FROM (
    SELECT kind, key, message, count, first_seen, last_seen FROM old WHERE acknowledged_at IS NULL UNION ALL SELECT kind, key, message, count, seen, seen FROM rows WHERE NOT done) GROUP BY kind, key""",
)
def _a33(v: Views) -> DataFrame:
    text = F.concat(F.lit("seen "), F.col("id").cast("string"), F.repeat(F.lit("."), (F.col("id") % 400).cast("int")))
    rows = v.audit.filter("action = 'login_failed' AND username <> ''").select(
        F.lit("login").alias("kind"), F.col("username").alias("key"), text.alias("message"), (F.col("id") % 9).alias("count"), F.col("created_at").alias("seen"), (F.col("id") % 3 == 0).alias("done")
    )
    even = F.substring("key", 5, 9).cast("long") % 2 == 0
    cut = F.left("message", F.lit(300))
    old = rows.filter("done").groupBy("kind", "key").agg(F.max_by(cut, F.struct(F.col("seen"), cut)).alias("message"), F.max("count").alias("count"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return upsert_notices(old.withColumn("acknowledged_at", F.when(even, F.col("last_seen"))), rows.filter("NOT done"))


_KEEP = "(review_required AND r.status NOT IN ('Reviewed', 'Closed')) OR EXISTS (SELECT 1 FROM {alerts} a WHERE a.event_id * 3 = r.record_id AND a.status IN ('Active', 'Acknowledged', 'Escalated'))"
_AGED = f"(SELECT r.*, 1705000000 - uploaded_s AS age, {_KEEP} AS needed FROM {{records}} r)"


@query(
    "a34_retention_plan",
    f"SELECT count(*) FILTER (age > 3 * 86400 AND age <= 7 * 86400 AND stored_file <> '' AND NOT needed) AS audio_files, count(*) FILTER (age > 7 * 86400 AND NOT needed) AS event_records, count(*) FILTER (age > 7 * 86400 AND needed) AS kept_open FROM {_AGED}",
)
def _a34(v: Views) -> DataFrame:
    return retention_plan(v.records, _few_alerts(v), 1705000000, 3, 7)


def _few_alerts(v: Views) -> DataFrame:
    """The alerts, moved to every third record, so that some old records have none."""
    return v.alerts.withColumn("event_id", F.col("event_id") * 3)


@query(
    "s4_retention_apply",
    f"SELECT record_id, CASE WHEN age > 3 * 86400 AND age <= 7 * 86400 AND NOT needed THEN '' ELSE stored_file END AS stored_file FROM {_AGED} WHERE NOT (age > 7 * 86400 AND NOT needed)",
)
def _s4(v: Views) -> DataFrame:
    return apply_retention(v.records, _few_alerts(v), 1705000000, 3, 7)[0].select("record_id", "stored_file")


@query(
    "s4_retention_events_and_alerts",
    f"""WITH gone AS (SELECT record_id FROM {_AGED} WHERE age > 7 * 86400 AND NOT needed) SELECT 'alert' AS kind, alert_id AS id FROM {{alerts}} WHERE event_id * 3 NOT IN (SELECT record_id FROM gone)
    UNION ALL SELECT 'event', event_id FROM {{sound_events}} WHERE record_id NOT IN (SELECT record_id FROM gone)""",
)
def _s4b(v: Views) -> DataFrame:
    _, alerts, events = apply_retention(v.records, _few_alerts(v), 1705000000, 3, 7, v.sound_events.select("event_id", "record_id"))
    return alerts.select(F.lit("alert").alias("kind"), F.col("alert_id").alias("id")).unionByName(events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))
