"""Search, visibility, review queue, ordering, timeline and export of sound events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions.rules import SEVERITIES, rank, rank_sql
from auralake.plans.registry import Views, query

ROLES_SEEING_ALL = ("reviewer", "security", "maintenance", "admin")
CLOSED_STATUSES = ("Reviewed", "Closed")


def with_effective(events: DataFrame) -> DataFrame:
    """effective_class, effective_severity and, where events have actions, effective_action: the reviewer's value unless blank or null, else the automatic one."""
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    found = {"effective_class": pick("reviewed_class", "final_class"), "effective_severity": pick("reviewed_severity", "severity")}
    if "recommended_action" in events.columns:
        found["effective_action"] = pick("reviewed_action", "recommended_action")
    return events.withColumns(found)


def local_day(column: str, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(column, zone))


def day_start(day: str, zone: str, later: int = 0) -> Column:
    """The instant at which a local day (or the one `later` days after) begins: a constant, so a filter on it reaches the scan."""
    return F.to_utc_timestamp(F.to_timestamp(F.date_add(F.to_date(F.lit(day)), later)), zone)


def validate_filters(filters: dict) -> None:
    """Reject unknown names and reversed ranges."""
    known = {"text", "category", "severity", "quality", "source", "owner", "date_from", "date_to", "min_confidence", "max_confidence", "review"}
    if unknown := set(filters) - known:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    for low, high in (("date_from", "date_to"), ("min_confidence", "max_confidence")):
        if filters.get(low) is not None and filters.get(high) is not None and filters[low] > filters[high]:
            raise ValueError(f"{low} is after {high}")


def search(events: DataFrame, filters: dict, zone: str = "UTC") -> DataFrame:
    """Events that pass every given filter; blank and None filters are skipped, confidences are percent."""
    validate_filters(filters)
    f = {k: v for k, v in filters.items() if v not in (None, "")}
    df = with_effective(events)
    if "text" in f:
        t = f["text"].strip().lower()
        df = df.filter((F.lower("code") == t) | F.lower("filename").contains(t))
    for name, column in (("category", "effective_class"), ("severity", "effective_severity"), ("quality", "quality_grade"), ("source", "source"), ("owner", "owner")):
        if name in f:
            df = df.filter(F.col(column) == f[name])
    if "date_from" in f:
        df = df.filter(F.col("created_at") >= day_start(f["date_from"], zone))
    if "date_to" in f:
        df = df.filter(F.col("created_at") < day_start(f["date_to"], zone, 1))
    if "min_confidence" in f:
        df = df.filter(F.col("python_confidence") >= f["min_confidence"] / 100)
    if "max_confidence" in f:
        df = df.filter(F.col("python_confidence") <= f["max_confidence"] / 100)
    states = {
        "waiting": F.col("review_required") & ~F.col("status").isin(*CLOSED_STATUSES),
        "reviewed": F.col("reviewed_class") != "",
        "corrected": (F.col("reviewed_class") != "") & (F.col("reviewed_class") != F.col("final_class")),
        "closed": F.col("status") == "Closed",
        "not_needed": ~F.col("review_required"),
    }
    return df.filter(states[f["review"]]) if "review" in f else df


def visible(rows: DataFrame, owner_col: str = "owner") -> DataFrame:
    """rows with `scope`: once under their owner, and once under '*' for the viewers that see all."""
    return rows.withColumn("scope", F.explode(F.array(F.lit("*"), F.col(owner_col)))).filter("scope IS NOT NULL")


def viewer_scopes(users: DataFrame) -> DataFrame:
    """users (viewer, role) with the scope of `visible` that each may read: '*' for roles that see all, else their own name."""
    return users.withColumn("scope", F.when(F.col("role").isin(*ROLES_SEEING_ALL), "*").otherwise(F.col("viewer")))


def visible_counts(rows: DataFrame, users: DataFrame, owner_col: str = "owner") -> DataFrame:
    """(viewer, role, n): how many rows each viewer may see; counts are joined by scope, so no viewer is paired with rows."""
    counted = visible(rows, owner_col).groupBy("scope").agg(F.count("*").alias("n"))
    return viewer_scopes(users).join(counted, "scope", "left").select("viewer", "role", F.coalesce("n", F.lit(0)).alias("n"))


def visible_to(rows: DataFrame, viewer: str, role: str, owner_col: str = "owner") -> DataFrame:
    return rows if role in ROLES_SEEING_ALL else rows.filter(F.col(owner_col) == viewer)


def review_queue(events: DataFrame, reason: str = "", severity: str = "", source: str = "") -> DataFrame:
    """Events waiting for review; reasons are an array column review_reasons."""
    df = with_effective(events).filter(F.col("review_required") & ~F.col("status").isin(*CLOSED_STATUSES))
    if reason:
        df = df.filter(F.array_contains("review_reasons", reason))
    if severity:
        df = df.filter(F.col("effective_severity") == severity)
    return df.filter(F.col("source") == source) if source else df


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of df in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[tuple[str, bool]], cursor: tuple | None, size: int) -> DataFrame:
    """The first `size` rows of df in a total order that come after the cursor, the sort key of the last row seen (None: from the start).

    order: (column, descending) of columns without nulls.  The cursor becomes a
    filter, whose bound on the first column reaches the scan, and each task keeps
    its own first rows, so a late page costs no more than an early one.
    """
    if cursor is not None:
        after, same = F.lit(False), F.lit(True)
        for (column, descending), last in zip(order, cursor, strict=True):
            c = F.col(column)
            after = after | (same & (c < F.lit(last) if descending else c > F.lit(last)))
            same = same & (c == F.lit(last))
        (column, descending), last = order[0], cursor[0]
        df = df.filter(F.col(column) <= F.lit(last) if descending else F.col(column) >= F.lit(last)).filter(after)
    return df.orderBy(*(F.desc(c) if descending else F.asc(c) for c, descending in order)).limit(size)


def panels(events: DataFrame, n: int = 6) -> DataFrame:
    """Latest n events of each dashboard panel, numbered; one pass over (event, panel) rows, top n before the shuffle."""
    named = F.array_compact(
        F.array(
            F.lit("latest"),
            F.when(F.col("effective_severity") == "Critical", "critical"),
            F.when((F.col("gtm_class") != "") & ~F.col("class_match"), "disagreements"),
            F.when(F.col("quality_grade").isin("Poor", "Unusable"), "poor quality"),
            F.when(F.col("review_required") & ~F.col("status").isin(*CLOSED_STATUSES), "waiting"),
        )
    )
    rows = with_effective(events).select("event_id", "created_at", F.explode(named).alias("panel"))
    w = Window.partitionBy("panel").orderBy(F.desc("created_at"), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def compared_classes(scores: DataFrame) -> DataFrame:
    """Full outer join of two models' class scores: (window_id, class_no, p, p2, difference, larger).

    A class that one model does not know has no score there and no difference;
    larger, by which a report is ordered, takes a missing score as 0.
    """
    one = scores.filter("p IS NOT NULL").select("window_id", "class_no", "p")
    two = scores.filter("p2 IS NOT NULL").select("window_id", "class_no", "p2")
    both = one.join(two, ["window_id", "class_no"], "full_outer")
    return both.withColumns({"difference": F.abs(F.col("p") - F.col("p2")), "larger": F.greatest("p", "p2")})


_EFFECTIVE = """coalesce(nullif(reviewed_class, ''), final_class) AS effective_class, coalesce(nullif(reviewed_severity, ''), severity) AS effective_severity,
    coalesce(nullif(reviewed_action, ''), recommended_action) AS effective_action"""
EVENTS_SQL = _EVENTS = f"(SELECT *, {_EFFECTIVE} FROM {{sound_events}}) e"


@query("p1_effective_values", f"SELECT event_id, effective_class, effective_severity, effective_action FROM {_EVENTS}")
def _p1(v: Views) -> DataFrame:
    return with_effective(v.sound_events).select("event_id", "effective_class", "effective_severity", "effective_action")


@query(
    "p2_event_search",
    f"""SELECT event_id, filename, effective_class, effective_severity FROM {_EVENTS} WHERE lower(filename) LIKE '%p_1%' ESCAPE '!'
    AND contains(lower(filename), 'p_1') AND effective_severity = 'Low' AND source = 'live' AND python_confidence >= 0.2 AND python_confidence <= 0.9
    AND CAST(created_at AS DATE) >= DATE '2024-01-02' AND CAST(created_at AS DATE) <= DATE '2024-01-20'""",
)
def _p2(v: Views) -> DataFrame:
    filters = {"text": "P_1", "severity": "Low", "source": "live", "min_confidence": 20, "max_confidence": 90, "date_from": "2024-01-02", "date_to": "2024-01-20"}
    return search(v.sound_events, filters).select("event_id", "filename", "effective_class", "effective_severity")


@query("p2_search_by_review_state", f"SELECT event_id FROM {_EVENTS} WHERE reviewed_class <> '' AND reviewed_class <> final_class")
def _p2b(v: Views) -> DataFrame:
    return search(v.sound_events, {"review": "corrected"}).select("event_id")


@query(
    "p2_search_local_days",
    f"SELECT event_id FROM {_EVENTS} WHERE CAST(created_at + INTERVAL 5 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-06' AND (lower(code) = 'clip_3' OR contains(lower(filename), 'clip_3'))",
)
def _p2c(v: Views) -> DataFrame:
    return search(v.sound_events, {"date_from": "2024-01-05", "date_to": "2024-01-06", "text": " CLIP_3"}, "Asia/Karachi").select("event_id")


_ROLE = "CASE user_id % 7 WHEN 0 THEN 'admin' WHEN 3 THEN 'reviewer' ELSE 'user' END"


@query(
    "p4_row_visibility",
    f"""SELECT viewer, role, CASE WHEN role IN ('reviewer', 'admin') THEN (SELECT count(*) FROM {{sound_events}}) ELSE (SELECT count(*) FROM {{sound_events}} e WHERE e.owner = viewer) END AS n
    FROM (SELECT username AS viewer, {_ROLE} AS role FROM {{users}})""",
)
def _p4(v: Views) -> DataFrame:
    return visible_counts(v.sound_events, v.users.select(F.col("username").alias("viewer"), F.expr(_ROLE).alias("role")))


@query(
    "p5_review_queue",
    f"SELECT event_id, effective_severity FROM {_EVENTS} WHERE review_required AND status NOT IN ('Reviewed', 'Closed') AND contains(reasons_text, 'Poor audio quality') AND source = 'upload'",
)
def _p5(v: Views) -> DataFrame:
    events = v.sound_events.withColumn("review_reasons", F.split("reasons_text", "; "))
    return review_queue(events, reason="Poor audio quality", source="upload").select("event_id", "effective_severity")


@query(
    "j8_event_view_with_alerts",
    """SELECT e.event_id, e.owner, count(a.alert_id) AS n_alerts, coalesce(sum(CASE WHEN a.critical THEN 1 ELSE 0 END), 0) AS n_critical
    FROM {sound_events} e LEFT JOIN {alerts} a ON a.event_id = e.event_id GROUP BY e.event_id, e.owner""",
)
def _j8(v: Views) -> DataFrame:
    per = v.alerts.groupBy("event_id").agg(F.count("*").alias("n_alerts"), F.count_if("critical").alias("n_critical"))
    return v.sound_events.select("event_id", "owner").join(per, "event_id", "left").fillna(0, ["n_alerts", "n_critical"])


@query(
    "j9_alerts_of_filtered_events",
    "SELECT alert_id FROM {alerts} a WHERE EXISTS (SELECT 1 FROM {sound_events} e WHERE e.event_id = a.event_id AND e.source = 'live' AND e.quality_grade = 'Good')",
)
def _j9(v: Views) -> DataFrame:
    chosen = search(v.sound_events, {"source": "live", "quality": "Good"}).select("event_id")
    return v.alerts.join(chosen, "event_id", "left_semi").select("alert_id")


@query(
    "j15_class_comparison",
    """SELECT coalesce(a.window_id, b.window_id) AS window_id, coalesce(a.class_no, b.class_no) AS class_no, p, p2, abs(p - p2) AS difference, greatest(coalesce(p, 0), coalesce(p2, 0)) AS larger
    FROM (SELECT window_id, class_no, p FROM {scores} WHERE class_no <= 7) a FULL JOIN (SELECT window_id, class_no, p2 FROM {scores} WHERE class_no >= 2) b ON a.window_id = b.window_id AND a.class_no = b.class_no""",
)
def _j15(v: Views) -> DataFrame:
    return compared_classes(v.scores.withColumns({"p": F.when(F.col("class_no") <= 7, F.col("p")), "p2": F.when(F.col("class_no") >= 2, F.col("p2"))}))


@query(
    "l1_review_queue_order",
    f"""SELECT event_id, row_number() OVER (ORDER BY {rank_sql("effective_severity", SEVERITIES)} DESC, created_at, event_id) AS place
    FROM {_EVENTS} WHERE review_required AND status NOT IN ('Reviewed', 'Closed') QUALIFY place <= 100""",
)
def _l1(v: Views) -> DataFrame:
    order = [F.desc(rank("effective_severity", SEVERITIES)), F.col("created_at"), F.col("event_id")]
    first = page(review_queue(v.sound_events), order, 1, 100)  # the queue's first page is the feature
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("event_id", "place")


@query(
    "l2_alert_attention_order",
    f"SELECT alert_id, severity FROM {{alerts}} WHERE status IN ('Active', 'Escalated') ORDER BY {rank_sql('severity', SEVERITIES)} DESC, created_at DESC, alert_id DESC LIMIT 50",
)
def _l2(v: Views) -> DataFrame:
    order = [F.desc(rank("severity", SEVERITIES)), F.desc("created_at"), F.desc("alert_id")]
    return page(v.alerts.filter("status IN ('Active', 'Escalated')"), order, 1, 50).select("alert_id", "severity")


@query(
    "l3_dashboard_panels",
    f"""SELECT panel, event_id, n FROM (SELECT panel, event_id, row_number() OVER (PARTITION BY panel ORDER BY created_at DESC, event_id DESC) AS n FROM (
    SELECT 'latest' AS panel, event_id, created_at FROM {_EVENTS}
    UNION ALL SELECT 'critical', event_id, created_at FROM {_EVENTS} WHERE effective_severity = 'Critical'
    UNION ALL SELECT 'disagreements', event_id, created_at FROM {_EVENTS} WHERE gtm_class <> '' AND NOT class_match
    UNION ALL SELECT 'poor quality', event_id, created_at FROM {_EVENTS} WHERE quality_grade IN ('Poor', 'Unusable')
    UNION ALL SELECT 'waiting', event_id, created_at FROM {_EVENTS} WHERE review_required AND status NOT IN ('Reviewed', 'Closed'))) WHERE n <= 6""",
)
def _l3(v: Views) -> DataFrame:
    return panels(v.sound_events).select("panel", "event_id", "n")


@query("l4_pagination", "SELECT event_id, created_at FROM {sound_events} ORDER BY created_at DESC, event_id LIMIT 25 OFFSET 50")
def _l4(v: Views) -> DataFrame:
    return page(v.sound_events, [F.desc("created_at"), "event_id"], 3, 25).select("event_id", "created_at")


@query(
    "l4_cursor_pages",
    "SELECT event_id, created_at, CAST((n - 1) // 25 + 1 AS INTEGER) AS page FROM (SELECT event_id, created_at, row_number() OVER (ORDER BY created_at DESC, event_id) AS n FROM {sound_events}) WHERE n <= 100",
)
def _l4b(v: Views) -> DataFrame:
    """Four pages, each asked for with the last row of the one before."""
    order, cursor, pages = [("created_at", True), ("event_id", False)], None, []
    for number in range(1, 5):
        rows = page_after(v.sound_events.select("event_id", "created_at"), order, cursor, 25).collect()  # a page
        pages += [(r["event_id"], r["created_at"], number) for r in rows]
        cursor = (rows[-1]["created_at"], rows[-1]["event_id"]) if rows else cursor
    return v.spark.createDataFrame(pages, "event_id long, created_at timestamp, page int")


@query(
    "w11_timeline_by_day",
    "SELECT CAST(created_at AS DATE) AS day, event_id, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at DESC, event_id) AS place FROM {sound_events}",
)
def _w11(v: Views) -> DataFrame:
    df = v.sound_events.withColumn("day", local_day("created_at", "UTC"))
    w = Window.partitionBy("day").orderBy(F.desc("created_at"), "event_id")
    return df.select("day", "event_id", F.row_number().over(w).alias("place"))
