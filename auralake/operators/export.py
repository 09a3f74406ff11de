"""The denormalised event view and its export for spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions.text import safe_cell
from auralake.operators.events import EVENTS_SQL, with_effective
from auralake.plans.registry import Views, query
from auralake.sources.files import read_export, scratch, write_export

#: Fixed format: the heading of each exported column, and the name it has here.
EXPORT = (
    ("Event ID", "code"), ("Audio ID", "record_code"), ("Processed at", "processed_at"), ("Source", "source"), ("Live session", "session_code"), ("User", "user_code"),
    ("Username", "username"), ("File name", "original_filename"), ("Format", "format"), ("Duration (s)", "duration_s"), ("Sampling rate (Hz)", "sample_rate"),
    ("Channels", "channels"), ("Bit depth", "bit_depth"), ("File size (bytes)", "file_size"), ("SHA-256", "sha256"), ("Duplicate of", "duplicate_code"),
    ("Audio quality", "quality_grade"), ("Quality issues", "quality_issues"), ("Python model version", "python_model_version"), ("Python prediction", "python_class"),
    ("Python confidence", "python_confidence"), ("Python top-two margin", "python_margin"), ("Python top 3", "python_top3"), ("GTM model version", "gtm_model_version"),
    ("GTM prediction", "gtm_class"), ("GTM confidence", "gtm_confidence"), ("GTM top 3", "gtm_top3"), ("GTM error", "gtm_error"),
    ("Confidence difference", "confidence_difference"), ("Model agreement", "consistency"), ("Final class (automatic)", "final_class"),
    ("Confidence level", "confidence_level"), ("Severity (automatic)", "severity"), ("Alert status", "alert_status"), ("Alerts", "alerts"),
    ("Review required", "review_required"), ("Review reasons", "review_reasons"), ("Status", "status"), ("Reviewer decision", "reviewed_class"),
    ("Reviewed severity", "reviewed_severity"), ("Reviewed by", "reviewed_by"), ("Reviewed at", "reviewed_at"), ("Recommended action", "effective_action"),
)


def event_view(events: DataFrame, records: DataFrame, users: DataFrame, sessions: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every event with its record, the record's owner and session, the code of the record it repeats, and its alerts as one text.

    Alerts are gathered before the join (an event has few); the users, sessions
    and record codes are joined by their ids, which Spark broadcasts only below
    its own size limit.
    """
    ordered = F.array_sort(F.collect_list(F.struct("alert_id", "alert_code", "status")))
    listed = alerts.groupBy("event_id").agg(F.array_join(F.transform(ordered, lambda a: F.concat_ws(" ", a["alert_code"], a["status"])), "; ").alias("alerts"))
    codes = records.select(F.col("record_id").alias("repeats"), F.col("record_code").alias("duplicate_code"))
    described = (
        records.withColumn("repeats", F.coalesce("duplicate_of", "near_duplicate_of"))
        .join(codes, "repeats", "left")
        .join(users.withColumnRenamed("user_id", "owner_id"), "owner_id", "left")
        .join(sessions, "session_id", "left")
        .drop("repeats", "owner_id", "session_id", "duplicate_of", "near_duplicate_of")
    )
    effective = with_effective(events)
    own = [c for c in effective.columns if c not in described.columns or c == "record_id"]  # the record's name, grade and so on count
    return effective.select(*own).join(described, "record_id", "left").join(listed, "event_id", "left")


def top_text(scores: str, n: int = 3) -> Column:
    """'class p; ...' of the n best of an array of (class, p); of equal scores the first in the array comes first."""
    ranked = F.array_sort(F.transform(F.col(scores), lambda s, i: F.struct((-s["p"]).alias("m"), i.alias("i"), s["class"].alias("c"))))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda s: F.format_string("%s %.3f", s["c"], -s["m"])), "; ")


def export_rows(view: DataFrame, zone: str = "UTC") -> DataFrame:
    """The spreadsheet's columns (EXPORT) of an event_view that also has python_scores and gtm_scores.

    Missing texts become '', times local, lists are joined by '; ', and text that
    a spreadsheet would read as a formula is made safe.
    """
    local = lambda c: F.date_format(F.from_utc_timestamp(c, zone), "yyyy-MM-dd HH:mm:ss")
    made = view.withColumns(
        {
            "processed_at": local("created_at"),
            "reviewed_at": local("reviewed_at"),
            "duration_s": F.round("duration_s", 3),
            "confidence_difference": F.round(F.abs(F.col("python_confidence") - F.col("gtm_confidence")), 4),
            "python_confidence": F.round("python_confidence", 4),
            "python_margin": F.round("python_margin", 4),
            "gtm_confidence": F.round("gtm_confidence", 4),
            "python_top3": top_text("python_scores"),
            "gtm_top3": top_text("gtm_scores"),
            "review_required": F.when(F.col("review_required"), "Yes").otherwise("No"),
            "review_reasons": F.col("reasons_text"),
        }
    ).select(*(c for _, c in EXPORT))
    return made.select(*(F.coalesce(safe_cell(c), F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in made.dtypes))


_ALERT_CODE = "'ALR-' || CAST(1000000 + alert_id AS STRING)"
_TOP3 = """array_to_string(list_transform(list_sort([{{'m': -({p}), 'i': 0, 'c': {c}}}, {{'m': -((1 - {p}) * 0.6), 'i': 1, 'c': 'Other sound'}}, {{'m': -((1 - {p}) * 0.4), 'i': 2, 'c': 'Silence'}}, {{'m': -((1 - {p}) * 0.0), 'i': 3, 'c': 'Rain'}}])[1:3],
    lambda s: s.c || ' ' || printf('%.3f', -s.m)), '; ')"""
_TIME = "strftime({0} + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S')"
_JOINED = f"""{EVENTS_SQL} LEFT JOIN {{audio_records}} r ON r.record_id = e.record_id LEFT JOIN {{audio_records}} d ON d.record_id = coalesce(r.duplicate_of, r.near_duplicate_of) LEFT JOIN {{users}} u ON u.user_id = r.owner_id
    LEFT JOIN {{sessions}} s ON s.session_id = r.session_id LEFT JOIN (SELECT event_id, string_agg({_ALERT_CODE} || ' ' || status, '; ' ORDER BY alert_id) AS alerts FROM {{alerts}} GROUP BY event_id) a ON a.event_id = e.event_id"""


def _view(v: Views) -> DataFrame:
    return event_view(v.sound_events, v.audio_records, v.users, v.sessions, v.alerts.withColumn("alert_code", F.expr(_ALERT_CODE)))


@query("j8_event_view", f"SELECT e.event_id, r.record_code, u.username, s.session_code, d.record_code AS duplicate_code, r.file_size, a.alerts FROM {_JOINED}")
def _j8(v: Views) -> DataFrame:
    return _view(v).select("event_id", "record_code", "username", "session_code", "duplicate_code", "file_size", "alerts")


@query(
    "io7_event_export",
    f"""SELECT e.code, coalesce(r.record_code, '') AS record_code, {_TIME.format("created_at")} AS processed_at, e.source, coalesce(s.session_code, '') AS session_code, coalesce(u.user_code, '') AS user_code, coalesce(u.username, '') AS username,
    coalesce(CASE WHEN left(r.original_filename, 1) IN ('=', '+', '-', '@') THEN '''' || r.original_filename ELSE r.original_filename END, '') AS original_filename, coalesce(r.format, '') AS format, round(r.duration_s, 3) AS duration_s,
    r.sample_rate, r.channels, r.bit_depth, r.file_size, coalesce(r.sha256, '') AS sha256, coalesce(d.record_code, '') AS duplicate_code, coalesce(r.quality_grade, '') AS quality_grade, coalesce(r.quality_issues, '') AS quality_issues,
    python_model_version, python_class, round(python_confidence, 4) AS python_confidence, round(python_margin, 4) AS python_margin, {_TOP3.format(p="python_confidence", c="python_class")} AS python_top3, gtm_model_version, gtm_class,
    round(gtm_confidence, 4) AS gtm_confidence, CASE WHEN gtm_confidence IS NULL THEN '' ELSE {_TOP3.format(p="gtm_confidence", c="gtm_class")} END AS gtm_top3, gtm_error, round(abs(python_confidence - gtm_confidence), 4) AS confidence_difference,
    consistency, final_class, confidence_level, severity, alert_status, coalesce(a.alerts, '') AS alerts, CASE WHEN review_required THEN 'Yes' ELSE 'No' END AS review_required, reasons_text AS review_reasons, e.status,
    reviewed_class, reviewed_severity, coalesce(reviewed_by, '') AS reviewed_by, coalesce({_TIME.format("reviewed_at")}, '') AS reviewed_at, effective_action FROM {_JOINED}""",
)
def _io7(v: Views) -> DataFrame:
    """Written as CSV with a byte-order mark and read back."""
    guess = lambda p, c: F.array(
        F.struct(F.col(c).alias("class"), F.col(p).alias("p")), *(F.struct(F.lit(n).alias("class"), ((1 - F.col(p)) * x).alias("p")) for n, x in (("Other sound", 0.6), ("Silence", 0.4), ("Rain", 0.0)))
    )
    scores = {"python_scores": guess("python_confidence", "python_class"), "gtm_scores": F.when(F.col("gtm_confidence").isNotNull(), guess("gtm_confidence", "gtm_class"))}
    rows = export_rows(_view(v).withColumns(scores), "Asia/Karachi")
    path = scratch(v.spark)
    write_export(rows, path, EXPORT)
    return read_export(v.spark, path, rows.schema, EXPORT)
