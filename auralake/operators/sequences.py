"""Runs, spans, repeats, episodes and as-of joins over ordered rows; anomaly counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions.rules import BACKGROUND, NON_EVENTS, UNKNOWN
from auralake.operators.ordering import in_chunks, placed, settled
from auralake.plans.registry import Views, query


def longest_run(windows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Longest run of consecutive equal values per key and value.

    A segmented scan: runs are found within range parts, so a key of any size is
    spread over tasks; then the first and last run of each part, two rows at
    most, are joined where a part goes on with the value that the one before
    ended with.
    """
    rows = placed(windows.select(*keys, *order, value), keys, order)
    own = Window.partitionBy(*keys, "_part").orderBy("_id")
    fresh = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(own))).cast("int"), F.lit(1))
    first_row = F.row_number().over(own) == 1
    marked = rows.withColumn("_fresh", F.when(first_row, 1).otherwise(fresh))
    runs = marked.withColumn("_run", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = settled(runs.groupBy(*keys, "_part", "_run", value).agg(F.count("*").alias("n")))
    last = runs.groupBy(*keys, "_part").agg(F.max("_run").alias("_last"))
    edges = runs.join(last, [*keys, "_part"]).filter("_run = 1 OR _run = _last")
    along = Window.partitionBy(*keys).orderBy("_part", "_run")
    goes_on = (F.col("_run") == 1) & F.col(value).eqNullSafe(F.lag(value).over(along)) & (F.lag("_part").over(along) < F.col("_part"))
    chains = edges.withColumn("_new", F.coalesce((~goes_on).cast("int"), F.lit(1)))
    chains = chains.withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, value, "_chain").agg(F.sum("n").alias("n"))
    return runs.select(*keys, value, "n").unionByName(chains.select(*keys, value, "n")).groupBy(*keys, value).agg(F.max("n").alias("longest"))


def event_spans(windows: DataFrame, key: str, start: str, end: str, value: str, confidence: str, min_confidence: float) -> DataFrame:
    """(key, span, class, start, end, n): windows of an event merged with the previous kept one when the class is the same and they touch.

    Windows of a class that is no event, or below min_confidence, are left out
    first, so they neither show nor part two marks that touch.  Whether a window
    begins a span is told by the one before; the first window of a range part
    asks the last one of the key's part before, and the span numbers of a part
    are moved up by those of earlier parts, so no key needs one task.
    """
    kept = windows.filter(~F.col(value).isin(*NON_EVENTS) & (F.col(confidence) >= min_confidence))
    rows = placed(kept, [key], [start, "window_id"])
    own = Window.partitionBy(key, "_part").orderBy("_id")
    row = F.struct(value, start, end)
    before = F.lag(row).over(own)
    edges = rows.groupBy(key, "_part").agg(F.max_by(row, "_id").alias("_ends"))
    along = Window.partitionBy(key).orderBy("_part")
    edges = edges.withColumn("_prior", F.lag("_ends").over(along)).drop("_ends")
    joined = rows.withColumn("_before", before).join(edges, [key, "_part"]).withColumn("_before", F.coalesce("_before", "_prior"))
    touches = (F.col(f"_before.{value}") == F.col(value)) & (F.col(start) <= F.col(f"_before.{end}"))
    marked = settled(joined.withColumn("_fresh", F.coalesce((~touches).cast("int"), F.lit(1))).select(key, "_part", "_id", "_fresh", "window_id", value, start, end))
    counts = marked.groupBy(key, "_part").agg(F.sum("_fresh").alias("_n"))
    counts = counts.withColumn("_moved", F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = marked.withColumn("_at", F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))).join(counts, [key, "_part"])
    return numbered.groupBy(key, (F.col("_at") + F.col("_moved")).alias("span")).agg(
        F.first(value).alias(value), F.min(start).alias("span_start"), F.max_by(end, F.struct(start, "window_id")).alias("span_end"), F.count("*").alias("n")
    )


def repeats_in_period(
    windows: DataFrame, seconds: int, key: str = "session_id", at: str = "seen_at", value: str = "class_name", chunk_seconds: int = 86_400
) -> DataFrame:
    """repeats: earlier windows of the same class within `seconds`, going back to the first that heard another class.

    Background and unknown windows do not stop the count, and a window of one of
    these counts its own class up to the last window of an event.  Windows at the
    same time are ordered by id.  Nothing older than `seconds` matters, so a
    session is cut into chunks of time, each with the windows of one period
    before it: a microphone that is always on gives many small groups.
    """
    width = max(chunk_seconds, seconds) * 1_000_000
    neutral = F.col(value).isin(BACKGROUND, UNKNOWN)
    timed = windows.withColumns({"_t": F.unix_micros(at), "_neutral": neutral})
    own = F.floor(F.col("_t") / width)
    next_too = F.when((own + 1) * width - F.col("_t") <= seconds * 1_000_000, own + 1)  # seen from the next chunk
    spread = timed.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_compact(F.array(own, next_too))))
    chunk = Window.partitionBy(key, "_chunk")
    w = chunk.orderBy("_t", "window_id")
    heard = F.last(F.when(~F.col("_neutral"), F.col(value)), ignorenulls=True)
    before = heard.over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.when(~F.col("_neutral"), F.coalesce((before != F.col(value)).cast("int"), F.lit(1))).otherwise(0)
    # an event's run of one class goes on over neutral windows; a neutral window's ends at the next event
    marked = spread.withColumns({"_changed": changed, "_event": (~F.col("_neutral")).cast("int")})
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    run = F.when(F.col("_neutral"), F.sum("_event").over(to_here)).otherwise(F.sum("_changed").over(to_here))
    same = Window.partitionBy(key, "_chunk", value, "_run").orderBy("_t")
    earlier = F.row_number().over(same.orderBy("_t", "window_id")) - 1
    too_old = F.count("*").over(same.rangeBetween(Window.unboundedPreceding, -seconds * 1_000_000 - 1))
    counted = marked.withColumn("_run", run).withColumn("repeats", F.greatest(earlier - too_old, F.lit(0)))
    return counted.filter("_chunk = _own").select(*windows.columns, "repeats")


def alert_episodes(
    windows: DataFrame, seconds: int, key: str = "session_id", at: str = "seen_at", value: str = "class_name", resolutions: DataFrame | None = None, chunk_seconds: int = 86_400
) -> DataFrame:
    """(key, class, started, windows): an alert-worthy window joins the alert created at most `seconds` before, else makes one.

    The gap counts from the alert's creation.  resolutions (key, class, time)
    close the alert that is open then; windows of the same moment come first.

    List ranking in place of a fold: a moment that follows a resolution, or the
    moment before by more than `seconds`, begins an alert in any case; every
    moment points to the first one more than `seconds` later that no such
    beginning precedes; doubled pointers mark what is reached from the
    beginnings.  Neighbours are sought in chunks of time, so one endless session
    is spread over tasks; the rounds grow with the logarithm of the longest chain.
    """
    limit = seconds * 1_000_000
    width = max(chunk_seconds * 1_000_000, 2 * limit + 1)
    ids = [key, value]
    moments = windows.select(*ids, F.unix_micros(at).alias("t")).groupBy(*ids, "t").agg(F.count("*").alias("n"))
    rows = moments.withColumn("resolved", F.lit(False))
    if resolutions is not None:
        ended = resolutions.select(*ids, F.unix_micros(at).alias("t")).distinct()
        rows = rows.unionByName(ended.select(*ids, "t", F.lit(0).cast("long").alias("n"), F.lit(True).alias("resolved")))
    chunk = Window.partitionBy(*ids, "_chunk").orderBy("t")
    earlier = chunk.rangeBetween(-limit, -1)
    window_t, resolved_t = F.when(~F.col("resolved"), F.col("t")), F.when(F.col("resolved"), F.col("t"))
    last, ended = F.max(window_t).over(earlier), F.max(resolved_t).over(earlier)
    seen = in_chunks(rows, "t", width, behind=limit).withColumn("head", last.isNull() | F.coalesce(ended >= last, F.lit(False)))
    nodes = settled(seen.filter("_chunk = _own AND NOT resolved").select(*ids, "t", "n", "head"))

    # chunks are wider than two limits: what isn't seen here is a beginning
    forward = in_chunks(nodes, "t", width, ahead=width)
    goal = F.min("t").over(chunk.rangeBetween(limit + 1, Window.unboundedFollowing))
    begins = F.min(F.when(F.col("head"), F.col("t"))).over(chunk.rangeBetween(1, Window.unboundedFollowing))
    forward = forward.withColumns({"goal": goal, "begins": begins}).filter("_chunk = _own AND goal IS NOT NULL AND (begins IS NULL OR begins > goal)")
    jumps = settled(forward.select(*ids, "t", "goal"))
    marked = nodes.filter("head").select(*ids, "t")
    while not jumps.isEmpty():
        reached = marked.join(jumps, [*ids, "t"]).select(*ids, F.col("goal").alias("t"))
        marked = settled(marked.unionByName(reached).distinct())
        onward = jumps.select(*ids, F.col("t").alias("goal"), F.col("goal").alias("further"))
        jumps = settled(jumps.join(onward, [*ids, "goal"]).select(*ids, "t", F.col("further").alias("goal")))

    begun = nodes.join(marked.withColumn("start", F.col("t")), [*ids, "t"], "left")
    since = F.max("start").over(chunk.rangeBetween(-limit, 0))
    told = in_chunks(begun, "t", width, behind=limit).withColumn("since", since).filter("_chunk = _own")
    return told.groupBy(*ids, "since").agg(F.sum("n").cast("int").alias("windows")).select(*ids, F.timestamp_micros("since").alias("started"), "windows")


def since_acknowledged(audit: DataFrame, acknowledged: DataFrame, key: str, now: str, minutes: int) -> DataFrame:
    """Rows of the counting period: after now - minutes and after the latest acknowledgement of their key."""
    latest = acknowledged.groupBy(key).agg(F.max("acknowledged_at").alias("acknowledged_at"))
    start = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {minutes} MINUTES")
    joined = audit.filter(F.col("created_at") >= start).join(latest, key, "left")
    return joined.filter(F.col("acknowledged_at").isNull() | (F.col("created_at") >= F.col("acknowledged_at"))).drop("acknowledged_at")


#: kind of notice: how many rows, within how many minutes.  Fixed values.
LIMITS = {"uploads": (5, 15), "logins": (5, 15), "duplicates": (3, 60), "critical alerts": (5, 60), "second model": (5, 60)}


def occurrences(audit: DataFrame, records: DataFrame, alerts: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, key, created_at) of everything that is counted: rejected uploads, failed logins, repeated files, critical alerts, second-model errors.

    records: owner, uploaded_at, duplicate (boolean); a blank user counts for no key.
    """
    named = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    by_name = F.concat(F.lit("username:"), F.col("username"))
    keys = F.array(
        F.when((F.col("action") == "upload_rejected") & (F.col("username") != ""), named("uploads", by_name)),
        F.when((F.col("action") == "login_failed") & (F.col("username") != ""), named("logins", by_name)),
        F.when((F.col("action") == "login_failed") & F.col("ip_address").isNotNull(), named("logins", F.concat(F.lit("ip_address:"), F.col("ip_address")))),
    )
    logged = audit.select("created_at", F.explode(F.array_compact(keys)).alias("x")).select("x.kind", "x.key", "created_at")
    copies = records.filter("duplicate").select(F.lit("duplicates").alias("kind"), F.col("owner").alias("key"), F.col("uploaded_at").alias("created_at"))
    critical = alerts.filter("critical").select(F.lit("critical alerts").alias("kind"), F.lit("").alias("key"), "created_at")
    errors = events.filter("gtm_error <> ''").select(F.lit("second model").alias("kind"), F.lit("GTM").alias("key"), "created_at")
    return logged.unionByName(copies).unionByName(critical).unionByName(errors)


def counters(found: DataFrame, acknowledged: DataFrame, now: str, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """(kind, key, n) of every key that reaches its kind's limit: rows of the kind's last minutes, none before its latest acknowledgement.

    found: kind, key, created_at (see occurrences); acknowledged: kind, key,
    acknowledged_at.  All kinds are counted in one pass with partial sums; a key
    without its own acknowledgement is counted whole.
    """
    t = F.to_timestamp(F.lit(now))
    minutes = F.create_map(*[F.lit(x) for k, (_, m) in limits.items() for x in (k, m)])
    least = F.create_map(*[F.lit(x) for k, (n, _) in limits.items() for x in (k, n)])
    longest = max(m for _, m in limits.values())
    recent = found.filter((F.col("created_at") >= t - F.expr(f"INTERVAL {longest} MINUTES")) & F.col("kind").isin(*limits))
    recent = recent.filter(F.col("created_at") >= t - F.make_dt_interval(mins=minutes[F.col("kind")]))
    latest = acknowledged.groupBy("kind", "key").agg(F.max("acknowledged_at").alias("acknowledged_at"))
    open_rows = recent.join(latest, ["kind", "key"], "left").filter("acknowledged_at IS NULL OR created_at >= acknowledged_at")
    return open_rows.groupBy("kind", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= least[F.col("kind")])


def low_confidence_spike(events: DataFrame, now: str, at_least: int = 10, share: float = 0.5, acknowledged_at: str | None = None) -> DataFrame:
    """One row: results and Low results of the last hour and of the seven days before, and whether that is a spike.

    Of the last hour only what came since the notice was acknowledged counts.
    """
    t = F.to_timestamp(F.lit(now))
    last_hour = F.col("created_at") >= t - F.expr("INTERVAL 1 HOUR")
    hour = last_hour & (F.col("created_at") >= F.to_timestamp(F.lit(acknowledged_at))) if acknowledged_at else last_hour
    week = (F.col("created_at") >= t - F.expr("INTERVAL 7 DAYS")) & ~last_hour
    low = F.col("confidence_level") == "Low"
    one = events.agg(F.count_if(hour).alias("recent"), F.count_if(hour & low).alias("recent_low"), F.count_if(week).alias("before"), F.count_if(week & low).alias("before_low"))
    usual = F.when(F.col("before") > 0, F.col("before_low") / F.col("before")).otherwise(0.0)
    now_share = F.col("recent_low") / F.nullif(F.col("recent"), F.lit(0))
    return one.withColumn("spike", F.coalesce((F.col("recent") >= at_least) & (now_share >= share) & (now_share >= 2 * usual), F.lit(False)))


def ongoing_alert(windows: DataFrame, alerts: DataFrame, seconds: int) -> DataFrame:
    """The latest unresolved alert of the same session and class created at most `seconds` before each window.

    A union of both sides in time order with the last alert carried forward: one
    shuffle by (session, class), no range join.
    """
    a = alerts.filter("status NOT IN ('Resolved', 'Dismissed')").select("session_id", F.col("category").alias("class_name"), F.col("created_at").alias("seen_at"), "alert_id", F.lit(None).cast("long").alias("window_id"))
    b = windows.select("session_id", "class_name", "seen_at", F.lit(None).cast("long").alias("alert_id"), "window_id")
    w = Window.partitionBy("session_id", "class_name").orderBy("seen_at", F.col("window_id").asc_nulls_first(), "alert_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("latest", F.last(F.when(F.col("alert_id").isNotNull(), F.struct("alert_id", F.col("seen_at").alias("since"))), ignorenulls=True).over(w))
    fresh = F.unix_micros("seen_at") - F.unix_micros("latest.since") <= seconds * 1_000_000
    return carried.filter("window_id IS NOT NULL").select("window_id", F.when(fresh, F.col("latest.alert_id")).alias("alert_id"))


def latest_request(users: DataFrame, audit: DataFrame, text: str = "") -> DataFrame:
    """users whose name contains the text in any case, with requested_role of their latest registration (null: none)."""
    rows = audit.filter("action = 'register' AND username <> ''")
    latest = rows.groupBy("username").agg(F.max_by("requested_role", F.struct("created_at", "id")).alias("requested_role"))
    return users.filter(F.contains(F.lower("username"), F.lit(text.strip().lower()))).join(latest, "username", "left")


@query(
    "w1_longest_run",
    """SELECT session_id, class_name, max(n) AS longest FROM (SELECT session_id, class_name, g, count(*) AS n FROM (SELECT session_id, class_name,
    row_number() OVER (PARTITION BY session_id ORDER BY seen_at, window_id) - row_number() OVER (PARTITION BY session_id, class_name ORDER BY seen_at, window_id) AS g FROM {live_windows}) GROUP BY ALL) GROUP BY ALL""",
)
def _w1(v: Views) -> DataFrame:
    return longest_run(v.live_windows, ["session_id"], ["seen_at", "window_id"], "class_name")


@query(
    "w2_event_spans",
    """SELECT session_id, span, any_value(class_name) AS class_name, min(s) AS span_start, arg_max(e, (s, window_id)) AS span_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY s, window_id ROWS UNBOUNDED PRECEDING) AS span FROM (
    SELECT *, CASE WHEN lag(class_name) OVER w = class_name AND s <= lag(e) OVER w THEN 0 ELSE 1 END AS f FROM (SELECT session_id, window_id, class_name, floor(epoch(seen_at)) AS s, floor(epoch(seen_at)) + 28800 AS e FROM {live_windows}
    WHERE class_name <> 'Background Noise' AND window_id % 4 <> 0) WINDOW w AS (PARTITION BY session_id ORDER BY s, window_id))) GROUP BY session_id, span""",
)
def _w2(v: Views) -> DataFrame:
    rows = v.live_windows.withColumns({"s": F.floor(F.unix_micros("seen_at") / 1e6).cast("double"), "confidence": F.when(F.col("window_id") % 4 == 0, 0.4).otherwise(0.5)})
    return event_spans(rows.withColumn("e", F.col("s") + 28_800), "session_id", "s", "e", "class_name", "confidence", 0.5)


_HEARD = "(SELECT *, date_trunc('hour', seen_at) AS h FROM {live_windows})"


@query(
    "w3_repeats_in_period",
    f"""WITH w AS (SELECT session_id, window_id, class_name, h FROM {_HEARD}) SELECT a.session_id, a.window_id, (SELECT count(*) FROM w b WHERE b.session_id = a.session_id AND b.class_name = a.class_name AND (b.h, b.window_id) < (a.h, a.window_id) AND b.h >= a.h - INTERVAL 36 HOUR
    AND NOT EXISTS (SELECT 1 FROM w x WHERE x.session_id = a.session_id AND x.class_name NOT IN (a.class_name, 'Background Noise', 'Unknown') AND (x.h, x.window_id) > (b.h, b.window_id) AND (x.h, x.window_id) < (a.h, a.window_id))) AS repeats FROM w a""",
)
def _w3(v: Views) -> DataFrame:
    """Times cut to the hour, so that many windows share one."""
    hourly = v.live_windows.withColumn("seen_at", F.date_trunc("hour", "seen_at"))
    return repeats_in_period(hourly, 129_600).select("session_id", "window_id", "repeats")


@query(
    "w4_alert_episodes",
    """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id, class_name ORDER BY t, resolved) AS n FROM (SELECT session_id, class_name, epoch_us(seen_at) AS t, CASE WHEN window_id % 9 = 4 THEN 1 ELSE 0 END AS resolved FROM {live_windows} WHERE alerting)),
    r AS (SELECT session_id, class_name, n, CASE WHEN resolved = 0 THEN t END AS s FROM o WHERE n = 1 UNION ALL
    SELECT o.session_id, o.class_name, o.n, CASE WHEN o.resolved = 1 THEN NULL WHEN r.s IS NOT NULL AND o.t - r.s <= 144000 * 1000000::BIGINT THEN r.s ELSE o.t END FROM r JOIN o ON o.session_id = r.session_id AND o.class_name = r.class_name AND o.n = r.n + 1)
    SELECT session_id, class_name, make_timestamp(s) AS started, CAST(count(*) AS INTEGER) AS windows FROM r WHERE s IS NOT NULL GROUP BY session_id, class_name, s""",
)
def _w4(v: Views) -> DataFrame:
    """Every ninth alerting window stands for the resolution of its session's alert."""
    rows = v.live_windows.filter("alerting")
    return alert_episodes(rows.filter("window_id % 9 <> 4"), 144_000, resolutions=rows.filter("window_id % 9 = 4"))


_ACKS = "(SELECT 'username:' || username AS key, max(created_at) AS acknowledged_at FROM {audit} WHERE id % 50 = 0 AND username <> '' GROUP BY username)"
_NOW = "TIMESTAMP '2024-01-15 00:00:00'"
#: The given events are days apart, so the queries count over days.
_DAYS = {"uploads": (5, 4320), "logins": (5, 4320), "duplicates": (3, 1440), "critical alerts": (5, 2880), "second model": (5, 1440)}


@query(
    "a31_anomaly_counters",
    f"""WITH found AS (SELECT 'uploads' AS kind, 'username:' || username AS key, created_at FROM {{audit}} WHERE action = 'upload_rejected' AND username <> ''
    UNION ALL SELECT 'logins', 'username:' || username, created_at FROM {{audit}} WHERE action = 'login_failed' AND username <> ''
    UNION ALL SELECT 'logins', 'ip_address:' || ip_address, created_at FROM {{audit}} WHERE action = 'login_failed' AND ip_address IS NOT NULL
    UNION ALL SELECT 'duplicates', owner, uploaded_at FROM (SELECT owner, TIMESTAMP '2024-01-14 00:00:00' + INTERVAL 9 HOUR * (record_id % 4) AS uploaded_at, min(record_id) OVER (PARTITION BY sha256) < record_id AS duplicate FROM {{records}}) WHERE duplicate
    UNION ALL SELECT 'critical alerts', '', created_at + INTERVAL 9490 DAY FROM {{alerts}} WHERE critical UNION ALL SELECT 'second model', 'GTM', created_at FROM {{sound_events}} WHERE gtm_error <> ''),
    acks AS (SELECT kind, key, max(created_at) AS acked FROM found WHERE (kind = 'logins' AND day(created_at) = 13) OR (kind = 'second model' AND hour(created_at) = 7) OR (kind = 'duplicates' AND key = 'user3') GROUP BY kind, key)
    SELECT f.kind, f.key, count(*) AS n FROM found f LEFT JOIN acks a ON a.kind = f.kind AND a.key = f.key WHERE (acked IS NULL OR created_at >= acked)
    AND created_at >= {_NOW} - CASE f.kind WHEN 'duplicates' THEN INTERVAL 1 DAY WHEN 'second model' THEN INTERVAL 1 DAY WHEN 'critical alerts' THEN INTERVAL 2 DAY ELSE INTERVAL 3 DAY END
    GROUP BY f.kind, f.key HAVING count(*) >= CASE f.kind WHEN 'duplicates' THEN 3 ELSE 5 END""",
)
def _a31(v: Views) -> DataFrame:
    first = v.records.groupBy("sha256").agg(F.min("record_id").alias("first"))
    records = v.records.join(first, "sha256").select(
        "owner", F.expr("TIMESTAMP '2024-01-14 00:00:00' + INTERVAL 9 HOUR * (record_id % 4)").alias("uploaded_at"), (F.col("first") < F.col("record_id")).alias("duplicate")
    )
    alerts = v.alerts.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 9490 DAYS"))
    found = occurrences(v.audit, records, alerts, v.sound_events)
    acked = (
        ((F.col("kind") == "logins") & (F.day("created_at") == 13)) | ((F.col("kind") == "second model") & (F.hour("created_at") == 7))
        | ((F.col("kind") == "duplicates") & (F.col("key") == "user3"))
    )
    return counters(found, found.filter(acked).withColumnRenamed("created_at", "acknowledged_at"), "2024-01-15 00:00:00", _DAYS)


@query(
    "j11_since_acknowledgement",
    f"SELECT x.id FROM {{audit}} x LEFT JOIN {_ACKS} a ON a.key = 'username:' || x.username WHERE created_at >= {_NOW} - INTERVAL 30 DAY AND (acknowledged_at IS NULL OR created_at >= acknowledged_at)",
)
def _j11(v: Views) -> DataFrame:
    acks = v.audit.filter("id % 50 = 0 AND username <> ''").select("username", F.col("created_at").alias("acknowledged_at"))
    return since_acknowledged(v.audit, acks, "username", "2024-01-15 00:00:00", 43_200).select("id")


@query(
    "a32_low_confidence_spike",
    """SELECT *, recent >= 10 AND recent_low / recent >= 0.3 AND recent_low / recent >= 2 * CASE WHEN before > 0 THEN before_low / before ELSE 0 END AS spike FROM (
    SELECT count(*) FILTER (h AND a) AS recent, count(*) FILTER (h AND a AND l) AS recent_low, count(*) FILTER (w AND NOT h) AS before, count(*) FILTER (w AND NOT h AND l) AS before_low FROM (
    SELECT created_at >= TIMESTAMP '2024-01-14 23:15:00' AS a, created_at >= TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR AS h, created_at >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY AS w, confidence_level = 'Low' AS l FROM {sound_events}))""",
)
def _a32(v: Views) -> DataFrame:
    return low_confidence_spike(v.sound_events, "2024-01-15 00:00:00", share=0.3, acknowledged_at="2024-01-14 23:15:00")


@query(
    "j12_ongoing_alert",
    """SELECT w.window_id, (SELECT arg_max(a.alert_id, (epoch_us(a.created_at), a.alert_id)) FROM {alerts} a WHERE a.session_id = w.session_id AND a.category = w.class_name AND a.status NOT IN ('Resolved', 'Dismissed')
    AND a.created_at <= w.moved AND epoch_us(w.moved) - epoch_us(a.created_at) <= 2592000 * 1000000::BIGINT) AS alert_id FROM (SELECT *, seen_at - INTERVAL 9500 DAY AS moved FROM {live_windows}) w""",
)
def _j12(v: Views) -> DataFrame:
    moved = v.live_windows.withColumn("seen_at", F.col("seen_at") - F.expr("INTERVAL 9500 DAYS"))
    return ongoing_alert(moved, v.alerts, 2_592_000)


@query(
    "j14_latest_registration",
    """SELECT u.username, u.user_code, r.requested_role FROM {users} u LEFT JOIN (SELECT username, arg_max(requested_role, (epoch_us(created_at), id)) AS requested_role FROM {audit} WHERE action = 'register' AND username <> '' GROUP BY username) r
    ON r.username = u.username WHERE contains(u.username, 'ser1')""",
)
def _j14(v: Views) -> DataFrame:
    return latest_request(v.users, v.audit, " SER1").select("username", "user_code", "requested_role")


@query(
    "st2_session_totals",
    """SELECT session_id, min(seen_at) AS started, max(seen_at) AS ended, count(*) AS windows, count(*) FILTER (NOT silent) AS stored FROM (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN epoch_us(seen_at) - epoch_us(lag(seen_at) OVER (PARTITION BY session_id ORDER BY seen_at)) < 21600 * 1000000::BIGINT THEN 0 ELSE 1 END AS f FROM {live_windows})) GROUP BY session_id, g""",
)
def _st2(v: Views) -> DataFrame:
    return session_totals(v.live_windows, "6 hours")


def session_totals(windows: DataFrame, gap: str) -> DataFrame:
    """Per session, split where nothing came for `gap`: start, end, windows, and those that were stored (not silent).

    Works on a batch and, after a watermark on `seen_at`, on a stream in append mode.
    """
    return (
        windows.groupBy("session_id", F.session_window("seen_at", gap))
        .agg(F.min("seen_at").alias("started"), F.max("seen_at").alias("ended"), F.count("*").alias("windows"), F.count_if(~F.col("silent")).alias("stored"))
        .drop("session_window")
    )
