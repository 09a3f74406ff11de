"""Domain views: how the given tables stand for events, alerts, recordings and scores.

Each view is (tables it reads, SQL that Spark and DuckDB both run).  Numbers are
made by integer arithmetic, so both engines agree to the last bit.
"""

from __future__ import annotations

_CLASS = "CASE {0} WHEN 0 THEN 'Gunshot' WHEN 1 THEN 'Glass Breaking' WHEN 2 THEN 'Vehicle Horn' WHEN 3 THEN 'Animal Sound' WHEN 4 THEN 'Background Noise' ELSE 'Machinery Fault' END"
_SEVERITY = "CASE {0} WHEN 'Gunshot' THEN 'Critical' WHEN 'Glass Breaking' THEN 'High' WHEN 'Machinery Fault' THEN 'High' WHEN 'Vehicle Horn' THEN 'Low' WHEN 'Animal Sound' THEN 'Low' ELSE 'Informational' END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "keyed_events": (
        ("events",),
        "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}",
    ),
    "scored_events": (
        ("keyed_events",),
        f"""SELECT event_id, user_id, ts, k, event_type,
        {_CLASS.format("k % 6")} AS python_class,
        CAST((event_id * 37) % 1000 AS DOUBLE) / 1000 AS python_confidence,
        CAST((event_id * 53) % 700 AS DOUBLE) / 1000 AS python_margin,
        CASE WHEN (event_id + k) % 6 = 5 THEN '' WHEN event_id % 2 = 0 THEN {_CLASS.format("k % 6")} ELSE {_CLASS.format("(event_id + k) % 6")} END AS gtm_class,
        CASE WHEN (event_id + k) % 6 = 5 THEN NULL ELSE CAST((event_id * 71) % 1000 AS DOUBLE) / 1000 END AS gtm_confidence,
        CASE k % 4 WHEN 0 THEN 'Poor' WHEN 1 THEN 'Acceptable' WHEN 2 THEN 'Good' ELSE 'Unusable' END AS quality_grade
        FROM {{keyed_events}}""",
    ),
    "sound_events": (
        ("scored_events",),
        f"""SELECT event_id, user_id AS session_id, 'user' || CAST(user_id AS STRING) AS owner, ts AS created_at,
        CASE event_id % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'live' ELSE 'demo' END AS source,
        'Clip_' || CAST(event_id % 97 AS STRING) || '.wav' AS filename,
        'EVT-' || lpad(CAST(event_id AS STRING), CAST(greatest(6, length(CAST(event_id AS STRING))) AS INT), '0') AS code,
        python_class, python_confidence, python_margin, gtm_class, gtm_confidence, quality_grade,
        gtm_class = python_class AS class_match,
        CASE WHEN gtm_class = '' THEN 'Uncertain' WHEN gtm_class = python_class THEN 'Acceptable Match' ELSE 'Disagreement' END AS consistency,
        CASE WHEN python_confidence < 0.35 THEN 'Unknown' ELSE python_class END AS final_class,
        CASE WHEN python_confidence < 0.35 THEN 'Informational' ELSE {_SEVERITY.format("python_class")} END AS severity,
        CASE WHEN python_confidence >= 0.8 THEN 'High' WHEN python_confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level,
        CASE k % 3 WHEN 0 THEN 'No alert' WHEN 1 THEN 'Not confirmed' ELSE 'Alert generated' END AS alert_status,
        k % 2 = 0 AS review_required,
        CASE WHEN k % 2 = 0 THEN CASE k % 4 WHEN 0 THEN 'Poor audio quality; Low confidence' ELSE 'Low confidence' END ELSE '' END AS reasons_text,
        CASE k % 5 WHEN 0 THEN 'Classified' WHEN 1 THEN 'Manual Review' WHEN 2 THEN 'Reviewed' WHEN 3 THEN 'Closed' ELSE 'Alert Generated' END AS status,
        CASE WHEN event_id % 7 = 0 THEN {_CLASS.format("k % 5")} ELSE '' END AS reviewed_class,
        CASE WHEN event_id % 14 = 0 THEN 'Low' ELSE '' END AS reviewed_severity,
        CASE WHEN event_id % 5 = 0 THEN {_CLASS.format("(k + event_id % 2) % 6")} ELSE '' END AS reference_class,
        CASE WHEN gtm_class = '' AND k % 2 = 0 THEN 'timeout' ELSE '' END AS gtm_error,
        CASE k % 4 WHEN 0 THEN 'wait' WHEN 1 THEN 'call' ELSE '' END AS recommended_action, CASE WHEN event_id % 14 = 0 THEN 'visit' ELSE '' END AS reviewed_action,
        CASE WHEN event_id % 7 = 0 THEN 'rev' || CAST(k % 3 AS STRING) END AS reviewed_by, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 HOUR END AS reviewed_at,
        event_id % 997 AS record_id, 'first-' || CAST(k % 3 AS STRING) AS python_model_version, CASE WHEN gtm_class = '' THEN '' ELSE 'second-1' END AS gtm_model_version,
        CASE WHEN event_id % 9 = 0 THEN '=SUM(A' || CAST(k AS STRING) || ')' ELSE 'note ' || CAST(k AS STRING) END AS comment
        FROM {{scored_events}}""",
    ),
    "alerts": (
        ("orders",),
        f"""SELECT o_orderkey AS alert_id, o_orderkey % 997 AS event_id, o_custkey % 50 AS session_id, o_orderdate AS created_at,
        {_CLASS.format("o_custkey % 6")} AS category,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Informational' ELSE 'Low' END AS severity,
        o_orderpriority = '1-URGENT' AS critical,
        CASE WHEN o_orderkey % 11 = 0 THEN 'Escalated' WHEN o_orderkey % 13 = 0 THEN 'Dismissed' WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Resolved' ELSE 'Acknowledged' END AS status,
        CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 30 ELSE NULL END AS escalate_after_minutes
        FROM {{orders}}""",
    ),
    "actions": (
        ("lineitem",),
        """SELECT l_orderkey AS alert_id, l_linenumber AS action_no, l_partkey * 8 + l_linenumber AS action_id, l_shipdate AS created_at,
        CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'op' || CAST(l_suppkey % 10 AS STRING) END AS username,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'acknowledge' WHEN 'AO' THEN 'escalate' WHEN 'NF' THEN 'dismiss' WHEN 'NO' THEN 'resolve' WHEN 'RF' THEN 'note' ELSE 'acknowledge' END AS action,
        CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'why ' || CAST(l_partkey % 7 AS STRING) END AS note
        FROM {lineitem}""",
    ),
    "audit": (
        ("keyed_events",),
        """SELECT event_id AS id, ts AS created_at, CASE WHEN user_id % 10 = 0 THEN '' ELSE 'user' || CAST(user_id AS STRING) END AS username,
        CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'click' THEN 'upload_rejected' WHEN 'signup' THEN 'register' ELSE 'view' END AS action,
        CASE WHEN user_id % 4 = 0 THEN NULL ELSE '10.0.0.' || CAST(user_id % 20 AS STRING) END AS ip_address,
        CASE k % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'reviewer' ELSE 'security' END AS requested_role
        FROM {keyed_events}""",
    ),
    "live_windows": (
        ("keyed_events",),
        f"""SELECT user_id AS session_id, event_id AS window_id, ts AS seen_at, {_CLASS.format("k % 6")} AS class_name,
        k % 6 = 0 OR k % 6 = 1 AS alerting, k % 4 = 3 AS silent FROM {{keyed_events}}""",
    ),
    "records": (
        ("documents",),
        """SELECT doc_id AS record_id, md5(text) AS sha256, 'user' || CAST(doc_id % 20 AS STRING) AS owner, doc_id % 20 AS owner_id,
        1704067200 + doc_id * 600 AS uploaded_s, source, lang AS class_name, CAST(n_chars AS BIGINT) AS size,
        CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'f' || CAST(doc_id AS STRING) END AS stored_file,
        CASE doc_id % 4 WHEN 0 THEN 'Reviewed' WHEN 1 THEN 'Manual Review' WHEN 2 THEN 'Closed' ELSE 'Classified' END AS status,
        doc_id % 3 = 0 AS review_required FROM {documents}""",
    ),
    "audio_records": (
        ("documents",),
        """SELECT doc_id AS record_id, 'AUD-' || CAST(1000000 + doc_id AS STRING) AS record_code, doc_id % 40 AS owner_id, CASE WHEN doc_id % 3 = 1 THEN doc_id % 7 END AS session_id,
        CASE WHEN doc_id % 11 = 0 THEN '@' ELSE '' END || 'take' || CAST(doc_id AS STRING) || '.wav' AS original_filename, CASE doc_id % 2 WHEN 0 THEN 'WAV' ELSE 'FLAC' END AS format,
        CAST(n_chars % 600000 AS DOUBLE) / 1000 AS duration_s, 8000 + (doc_id % 6) * 8000 AS sample_rate, doc_id % 2 + 1 AS channels, CASE WHEN doc_id % 2 = 0 THEN 16 END AS bit_depth, CAST(n_chars AS BIGINT) AS file_size,
        md5(text) AS sha256, CASE WHEN doc_id % 5 = 4 THEN doc_id - 4 END AS duplicate_of, CASE WHEN doc_id % 6 = 5 THEN doc_id - 5 END AS near_duplicate_of,
        CASE doc_id % 3 WHEN 0 THEN 'Good' ELSE 'Poor' END AS quality_grade, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'noise: x' ELSE 'noise: x; clipping: y' END AS quality_issues FROM {documents}""",
    ),
    "users": (("customer",), "SELECT c_custkey AS user_id, 'user' || CAST(c_custkey AS STRING) AS username, 'USR-' || CAST(1000000 + c_custkey AS STRING) AS user_code FROM {customer}"),
    "sessions": (("nation",), "SELECT n_nationkey AS session_id, 'SES-' || n_name AS session_code FROM {nation}"),
    "clips": (
        ("customer", "nation"),
        """SELECT c_custkey AS clip_no, 'src' || CAST(c_custkey % 6 AS STRING) AS source, lower(c_name) || '.wav' AS path, c_mktsegment AS class_name,
        n_name || ':' || CAST(c_custkey % 23 AS STRING) AS group_id, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'o' || CAST(c_custkey % 400 AS STRING) END AS origin_id,
        CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS priority, CAST(c_custkey % 50 AS DOUBLE) / 10 AS duration_s, CAST((c_custkey * 7) % 1000 AS DOUBLE) / 1000 AS peak,
        CASE c_custkey % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split,
        CASE c_custkey % 5 WHEN 0 THEN 'Good' WHEN 1 THEN 'Acceptable' WHEN 2 THEN 'Poor' ELSE 'Good' END AS quality_grade,
        CASE c_custkey % 5 WHEN 1 THEN 'low signal: x' WHEN 2 THEN 'clipping: 2 %; noise: y' ELSE '' END AS quality_issues,
        md5(CAST(c_custkey % 1301 AS STRING)) AS sha256
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    ),
    "weights": (
        ("embeddings",),
        """SELECT vec_id AS window_id, vec_id % 251 AS clip_id, label AS y, i - 1 AS class_no,
        CAST(floor((a + 1) * 1000) AS BIGINT) AS w, CAST(floor((b + 1) * 1000) AS BIGINT) AS w2 FROM (
        SELECT vec_id, label, i, CASE i WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 WHEN 4 THEN e4 WHEN 5 THEN e5 WHEN 6 THEN e6 WHEN 7 THEN e7 WHEN 8 THEN e8 WHEN 9 THEN e9 ELSE e10 END AS a,
        CASE i WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 WHEN 4 THEN f4 WHEN 5 THEN f5 WHEN 6 THEN f6 WHEN 7 THEN f7 WHEN 8 THEN f8 WHEN 9 THEN f9 ELSE f10 END AS b
        FROM (SELECT vec_id, label, """
        + ", ".join(f"element_at(embedding, {i}) AS e{i}, element_at(embedding, {i + 10}) AS f{i}" for i in range(1, 11))
        + """ FROM {embeddings}) t CROSS JOIN (VALUES """
        + ", ".join(f"({i})" for i in range(1, 11))
        + """) AS n(i)) u""",
    ),
    "scores": (
        ("weights",),
        """SELECT window_id, clip_id, y, class_no, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY window_id) AS p,
        CAST(w2 AS DOUBLE) / sum(w2) OVER (PARTITION BY window_id) AS p2 FROM {weights}""",
    ),
    "top_scores": (
        ("scores",),
        """SELECT window_id, clip_id, y, max(CASE WHEN r = 1 THEN class_no END) AS pred, max(CASE WHEN r = 1 THEN p END) AS conf, max(CASE WHEN r = 2 THEN p END) AS second,
        max(CASE WHEN r2 = 1 THEN class_no END) AS pred2, max(CASE WHEN r2 = 1 THEN p2 END) AS conf2 FROM (
        SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY p DESC, class_no) AS r, row_number() OVER (PARTITION BY window_id ORDER BY p2 DESC, class_no) AS r2 FROM {scores}) t
        GROUP BY window_id, clip_id, y""",
    ),
}
