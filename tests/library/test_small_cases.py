"""Hand-made rows with exact numbers."""

import datetime as dt
import tempfile
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from auralake.functions import text
from auralake.functions.rules import rule_table
from auralake.functions.text import code
from auralake.operators.ordering import numbered, settled
from auralake.operators import alerts, analytics, dataset, decision, evaluation, events, learning, neardup, ordering, sequences, signals
from auralake.sources import files, versions
from auralake.streaming import jobs, messages

T0 = dt.datetime(2024, 5, 1, 12)
EVENT = {
    "event_id": 0, "code": "EVT-000000", "owner": "ana", "source": "upload", "filename": "a.wav", "created_at": T0, "quality_grade": "Good",
    "python_class": "Gunshot", "python_confidence": 0.8, "python_margin": 0.5, "gtm_class": "Gunshot", "gtm_confidence": 0.7, "class_match": True,
    "consistency": "Acceptable Match", "final_class": "Gunshot", "severity": "Critical", "confidence_level": "High", "alert_status": "No alert",
    "review_required": False, "reasons_text": "", "status": "Classified", "reviewed_class": "", "reviewed_severity": "", "reference_class": "",
}
SCHEMA = ", ".join(
    f"{k} " + ("long" if k == "event_id" else "timestamp" if k == "created_at" else "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "string")
    for k, v in EVENT.items()
)


def make(spark, *changes):
    rows = [{**EVENT, "event_id": i, "code": f"EVT-{i:06d}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[k] for k in EVENT) for r in rows], SCHEMA)


@pytest.fixture
def dashboard(spark):
    glass = {"python_class": "Glass Breaking", "final_class": "Glass Breaking", "severity": "High"}
    return make(
        spark,
        {"python_confidence": 0.9},
        {"python_confidence": 0.95, "gtm_class": "Glass Breaking", "class_match": False},
        {"python_class": "Vehicle Horn", "gtm_class": "Vehicle Horn", "final_class": "Vehicle Horn", "severity": "Low", "python_confidence": 0.45, "quality_grade": "Poor", "created_at": T0 - dt.timedelta(days=2)},
        {**glass, "gtm_class": "Glass Breaking", "python_confidence": 0.6, "reviewed_class": "Vehicle Horn", "reviewed_severity": "Low", "status": "Reviewed"},
        {"python_class": "Animal Sound", "final_class": "Animal Sound", "severity": "Low", "python_confidence": 0.7, "gtm_class": "", "gtm_confidence": None, "class_match": False},
    )


ALERTS = "alert_id long, event_id long, created_at timestamp, category string, severity string, critical boolean, status string, escalate_after_minutes double"
ACTIONS = "alert_id long, action_id long, created_at timestamp, username string, action string, note string"


def test_dashboard_numbers(spark, dashboard):
    none = spark.createDataFrame([], ALERTS)
    o = analytics.overview(dashboard, none).first()
    assert (o["total"], o["critical"], o["poor"], o["compared"], o["disagreements"], o["disagreement_rate"]) == (5, 2, 1, 4, 1, 0.25)
    assert abs(o["mean_confidence"] - 0.72) < 1e-9
    assert {r["effective_class"]: r["n"] for r in analytics.by_category(dashboard).collect()} == {"Gunshot": 2, "Vehicle Horn": 2, "Animal Sound": 1}
    days = {str(r["day"]): (r["events"], r["critical"]) for r in analytics.daily(dashboard, "2024-04-25", 7).collect()}
    assert len(days) == 7 and days["2024-05-01"] == (4, 2) and days["2024-04-29"] == (1, 0) and days["2024-04-28"] == (0, 0)
    bins = {r["bin"]: (r["first"], r["second"]) for r in analytics.confidence_histogram(dashboard).collect()}
    assert bins[9][0] == 2 and bins[4][0] == 1 and sum(s for _, s in bins.values()) == 4
    errors = {r["class_name"]: r for r in analytics.errors_by_class(dashboard, none).collect()}
    assert errors["Glass Breaking"]["fp"] == 1 and errors["Vehicle Horn"]["fn"] == 1


def test_overview_of_nothing(spark, dashboard):
    o = analytics.overview(dashboard.limit(0), spark.createDataFrame([], ALERTS)).first()
    assert o["total"] == 0 and o["disagreement_rate"] is None


def test_alert_response(spark):
    a = spark.createDataFrame([(1, 1, T0, "Gunshot", "Critical", True, "Acknowledged", 2.0), (2, 2, T0, "Gunshot", "Critical", True, "Dismissed", 2.0)], ALERTS)
    steps = spark.createDataFrame([(1, 1, T0 + dt.timedelta(minutes=4), "ana", "acknowledge", ""), (2, 2, T0 + dt.timedelta(minutes=2), None, "escalate", "")], ACTIONS)
    r = analytics.alert_response(a, steps).first()
    assert (r["alerts"], r["handled"], r["median_minutes"], r["auto_escalated"], r["dismissed"], r["open"]) == (2, 1, 4.0, 1, 1, 1)


def test_search_filters(spark):
    e = make(spark, {"filename": "Door.wav"}, {"owner": "bo", "created_at": T0 - dt.timedelta(days=3)}, {"reviewed_class": "Vehicle Horn", "python_confidence": 0.4}, {"review_required": True, "status": "Manual Review"})
    ids = lambda f: sorted(r["event_id"] for r in events.search(e, f).collect())
    assert ids({"text": "evt-000002"}) == [2] and ids({"text": "DOOR"}) == [0] and ids({"owner": "bo"}) == [1]
    assert ids({"category": "Vehicle Horn"}) == [2] and ids({"max_confidence": 50}) == [2] and ids({"date_to": "2024-04-29"}) == [1]
    assert ids({"review": "waiting"}) == [3] and ids({"review": "corrected"}) == [2] and ids({}) == [0, 1, 2, 3]
    for bad in ({"date_from": "2024-05-02", "date_to": "2024-05-01"}, {"min_confidence": 60, "max_confidence": 50}, {"colour": "red"}):
        with pytest.raises(ValueError):
            events.search(e, bad)


def test_review_and_alert_replay(spark):
    steps = [(1, 1, T0, "a", "resolve", ""), (1, 2, T0 + dt.timedelta(minutes=1), "a", "acknowledge", ""), (1, 3, T0 + dt.timedelta(minutes=2), "a", "dismiss", " "), (1, 4, T0 + dt.timedelta(minutes=3), "a", "resolve", ""), (2, 5, T0, "a", "note", "")]
    got = {r["alert_id"]: (r["status"], r["refused"]) for r in alerts.replay_actions(spark.createDataFrame(steps, ACTIONS)).collect()}
    assert got == {1: ("Resolved", 2), 2: ("Active", 1)}
    reviews = spark.createDataFrame(
        [(1, 1, "correct", "Gunshot", "Vehicle Horn", "", ""), (1, 2, "close", "Gunshot", None, None, None), (2, 1, "correct", "Gunshot", "Gunshot", "", "go"), (3, 1, "confirm", "Gunshot", None, "High", None), (3, 2, "reopen", "Gunshot", None, None, None)],
        "event_id long, step long, kind string, final_class string, new_class string, severity string, action string",
    )
    got = {r["event_id"]: tuple(r)[1:] for r in alerts.replay_reviews(reviews, rule_table(spark)).collect()}
    assert got == {1: ("Vehicle Horn", "Low", "nothing to do", "Closed"), 2: ("Gunshot", "", "go", "Reviewed"), 3: ("Gunshot", "High", "", "Manual Review")}


def test_escalation(spark):
    a = spark.createDataFrame([(1, 1, T0, "Gunshot", "Critical", True, "Active", 2.0), (2, 2, T0, "x", "Low", False, "Active", None), (3, 3, T0, "Gunshot", "Critical", True, "Acknowledged", 2.0)], ALERTS)
    after, log = alerts.escalate(a, "2024-05-01 12:02:00")
    assert {r["alert_id"]: r["status"] for r in after.collect()} == {1: "Escalated", 2: "Active", 3: "Acknowledged"} and log.count() == 1
    assert alerts.overdue(a, "2024-05-01 12:01:59").count() == 0


def windows(spark, *names, step=4, alerting=True):
    rows = [(1, i, T0 + dt.timedelta(seconds=step * i), n, alerting, n == "") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "session_id long, window_id long, seen_at timestamp, class_name string, alerting boolean, silent boolean")


def test_repeats_skip_neutral_windows(spark):
    first = windows(spark, "Machinery Fault", "Background Noise", "Machinery Fault", "Horn", "Machinery Fault", step=2)
    got = {r["window_id"]: r["repeats"] for r in sequences.repeats_in_period(first, 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}
    quiet = windows(spark, "Background Noise", "Unknown", "Background Noise", "Horn", "Background Noise", "Background Noise", step=2)
    for chunk in (10, 86_400):
        got = {r["window_id"]: r["repeats"] for r in sequences.repeats_in_period(quiet, 10, chunk_seconds=chunk).collect()}
        assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    same = {r["window_id"]: r["repeats"] for r in sequences.repeats_in_period(windows(spark, *["Horn"] * 4, step=0), 10).collect()}
    assert same == {0: 0, 1: 1, 2: 2, 3: 3}


def test_episodes_count_from_the_alert(spark):
    got = sorted((r["started"], r["windows"]) for r in sequences.alert_episodes(windows(spark, *["Gunshot"] * 5, step=25), 60).collect())
    assert got == [(T0, 3), (T0 + dt.timedelta(seconds=75), 2)]
    late = windows(spark, "Gunshot", "Gunshot", step=15).withColumn("seen_at", F.expr("seen_at + INTERVAL '11:59:50' HOUR TO SECOND"))
    assert [r["windows"] for r in sequences.alert_episodes(late, 60).collect()] == [2]  # over midnight
    closed = windows(spark, "Gunshot", "Gunshot", "Gunshot", step=10)
    ends = closed.filter("window_id = 1").withColumn("seen_at", F.expr("seen_at + INTERVAL 1 SECOND"))
    assert sorted(r["windows"] for r in sequences.alert_episodes(closed, 60, resolutions=ends).collect()) == [1, 2]


def test_longest_run_and_spans(spark):
    w = windows(spark, "a", "a", "b", "a", "a", "a")
    assert {r["class_name"]: r["longest"] for r in sequences.longest_run(w, ["session_id"], ["seen_at"], "class_name").collect()} == {"a": 3, "b": 1}


def test_decision_cases(spark):
    cases = [
        ("Gunshot", 0.9, 0.5, "Gunshot", 0.8, "Good", 2, 3, None),
        ("Gunshot", 0.9, 0.5, "Gunshot", 0.8, "Good", 1, 3, None),
        ("Gunshot", 0.9, 0.5, "Gunshot", 0.8, "Good", 1, 1, None),
        ("Gunshot", 0.3, 0.5, "Gunshot", 0.8, "Good", 2, 3, None),
        ("Aggression", 0.9, 0.5, "Aggression", 0.8, "Good", 3, 3, None),
        ("Background Noise", 0.9, 0.5, "Background Noise", 0.8, "Good", 1, 1, -10.0),
        ("Vehicle Horn", 0.9, 0.05, "", None, "Poor", 1, 1, None),
    ]
    schema = "python_class string, python_confidence double, python_margin double, gtm_class string, gtm_confidence double, quality_grade string, repeated_detections int, n_windows int, noise_dbfs double"
    df = spark.createDataFrame(cases, schema).withColumn("overlaps", F.array().cast("array<string>")).withColumn("i", F.monotonically_increasing_id())
    got = [r for r in decision.decide(df, rule_table(spark)).orderBy("i").collect()]
    assert [r["alert_status"] for r in got] == ["Alert generated", "Not confirmed", "Alert generated", "No alert", "Alert generated", "Alert generated", "No alert"]
    assert got[1]["review_reasons"] == ["Possible false alarm"] and got[1]["status"] == "Manual Review"
    assert got[3]["final_class"] == "Unknown" and got[3]["review_reasons"] == ["Low confidence", "Unsupported sound pattern"]
    assert got[4]["severity"] == "Critical" and got[5]["severity"] == "Medium" and got[0]["confidence_level"] == "High"
    assert got[6]["review_reasons"] == ["GTM result unavailable", "Poor audio quality", "Similar top-class confidence scores"] and got[6]["status"] == "Uncertain"


def test_clip_scores_and_metrics(spark):
    rows = [(1, w, p) for w, p in enumerate(([0.6, 0.3, 0.1], [0.6, 0.3, 0.1], [0.05, 0.05, 0.9], [0.34, 0.33, 0.33]))]
    s = spark.createDataFrame(rows[:3], "clip_id long, window_id long, probs array<double>")
    clips_ = spark.createDataFrame([(1,), (2,)], "clip_id long")
    scored = lambda m, w=s: {r["clip_id"]: r for r in evaluation.clip_scores(w, clips_, 3, m).withColumn("pred", evaluation.predicted(F.col("probs"))).collect()}
    assert scored("mean")[1]["pred"] == 0 and scored("max")[1]["pred"] == 2 and abs(sum(scored("max")[1]["probs"]) - 1) < 1e-9
    assert all(abs(p - 1 / 3) < 1e-9 for p in scored("mean")[2]["probs"])  # no windows
    four = spark.createDataFrame(rows, "clip_id long, window_id long, probs array<double>")
    assert np.allclose(scored("top3", four)[1]["probs"], scored("mean")[1]["probs"])
    t = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0), (2, 2), (2, 2)], "y int, pred int")
    got = {r["class_no"]: r for r in evaluation.class_metrics(evaluation.confusion(t, "y", "pred", 3)).collect()}
    assert got[1]["recall"] == 0.5 and abs(got[0]["precision"] - 2 / 3) < 1e-9
    assert evaluation.confusion(t, "y", "pred", 3).count() == 9


def test_temperature_keeps_rankings(spark):
    rows = [(w, w % 3, [0.97, 0.02, 0.01] if w % 2 else [0.1, 0.2, 0.7]) for w in range(30)]
    s = spark.createDataFrame(rows, "window_id long, y int, probs array<double>")
    t = evaluation.fit_temperature(s)
    grid = [np.exp(g) for g in np.linspace(-3, 3, 2001)]
    p = np.array([r[2] for r in rows])
    nll = [-np.mean(np.log((p ** (1 / g) / (p ** (1 / g)).sum(axis=1, keepdims=True))[range(30), [r[1] for r in rows]])) for g in grid]
    assert t > 1.5 and abs(np.log(t) - np.log(grid[int(np.argmin(nll))])) < 0.03
    soft = s.select(evaluation.calibrated(F.col("probs"), t).alias("c"), "probs").collect()
    assert all(abs(sum(r["c"]) - 1) < 1e-9 and np.argsort(r["c"]).tolist() == np.argsort(r["probs"]).tolist() for r in soft)
    assert evaluation.fit_temperature(s.limit(0)) == 1.0


def test_two_model_summary(spark):
    rows = [("Gunshot", "Gunshot", 0.9, "Gunshot", 0.8, "Gunshot", False, True), ("Gunshot", "Gunshot", 0.8, "Vehicle Horn", 0.6, "Gunshot", True, True), ("Vehicle Horn", "Vehicle Horn", 0.7, None, None, "Vehicle Horn", False, False),
            ("Gunshot", "Animal Sound", 0.6, "Gunshot", 0.9, "Animal Sound", False, False)]
    df = spark.createDataFrame(rows, "actual string, pred string, conf double, pred2 string, conf2 double, final_class string, review boolean, alert boolean").withColumn("consistency", F.lit("x"))
    r = evaluation.model_summary(df, ["Gunshot"], ["Gunshot"]).first()
    assert (r["scored"], r["compared"], r["agree"], r["disagree"], r["disagree_first_right"], r["disagree_second_right"], r["missed_critical"], r["alerts_true"]) == (4, 3, 1, 2, 1, 1, 1, 2)
    m = {x["model"]: x["accuracy"] for x in evaluation.model_metrics(df).collect()}
    assert m == {"first": 0.75, "second": 0.5, "final": 0.75}


def test_group_splits(spark):
    g = spark.createDataFrame([("a", f"g{i}", 4) for i in range(100)], "class_name string, group_id string, n long")
    counts = {r["split"]: r["count"] for r in dataset.group_splits(g).groupBy("split").count().collect()}
    assert counts == {"train": 70, "validation": 15, "test": 15}
    assert sorted(dataset.group_splits(g).collect()) == sorted(dataset.group_splits(g.repartition(7)).collect())
    with pytest.raises(ValueError):
        dataset.group_splits(g, (0.5, 0.2, 0.2))


def test_runs_of_equal_groups_equal_the_rule_one_by_one():
    rng = np.random.default_rng(3)
    for weights in ([700_000, 150_000, 150_000], [1_000_000, 0, 0], [500_000, 0, 500_000]):
        for _ in range(400):
            counts, n, m = [int(x) for x in rng.integers(0, 60, 3)], int(rng.integers(1, 9)), int(rng.integers(1, 200))
            taken = [0, 0, 0]
            for _ in range(m):
                best = min((i for i in range(3) if weights[i]), key=lambda i: ((counts[i] + taken[i] * n) / weights[i], i))
                taken[best] += 1
            assert dataset._run_counts(counts, weights, n, m) == taken
    assert sum(dataset._run_counts([5, 0, 0], [700_000, 150_000, 150_000], 3, 10**9)) == 10**9


def test_extension_leaves_known_groups(spark):
    known = spark.createDataFrame([("g1", "test"), ("g9", "train")], "group_id string, split string")
    fresh = spark.createDataFrame([("a", "g1")] * 5 + [("a", "g2")] + [("b", "g2")] * 3 + [("b", "g3")] * 2 + [("c", "g4")], "class_name string, group_id string")
    got = {r["group_id"]: r["split"] for r in dataset.extension_splits(fresh, known).collect()}
    assert set(got) == {"g1", "g2", "g3", "g4"} and got["g1"] == "test"
    # class a has most new rows and decides on g2, alone in its class; b decides on g3 only
    assert got["g2"] == got["g3"] == got["g4"] == "train"


def test_extension_rejects_repeats_and_goes_on_with_ids(spark):
    row = "path string, sha256 string, class_name string, group_id string"
    old = spark.createDataFrame([("p1", "h1", "dog", "g1", "test", "DOG-00007")], row + ", split string, audio_id string")
    new = spark.createDataFrame([("p1", "hx", "dog", "g1"), ("p2", "h1", "dog", "g1"), ("p3", "h3", "dog", "g1"), ("p4", "h3", "cat", "g2"), ("p5", "h5", "cat", "g1")], row)
    rows, rejected = dataset.extend_dataset(old, new)
    got = {r["path"]: (r["split"], r["audio_id"], r["added"]) for r in rows.collect()}
    assert got == {"p1": ("test", "DOG-00007", False), "p3": ("test", "DOG-00008", True), "p5": ("test", "CAT-00001", True)}
    assert {r["path"]: r["reason"] for r in rejected.collect()} == {"p2": "exact duplicate (of p1)", "p4": "exact duplicate (of p3)"}


def test_numbers_are_exact_over_partitions(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS k", "CAST(id * 7919 % 5000 AS INT) AS v").repartition(7)
    got = numbered(rows, ["k"], ["v"]).collect()
    for k in range(3):
        own = sorted((r["v"], r["row_no"]) for r in got if r["k"] == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert numbered(rows.limit(0), ["k"], ["v"]).count() == 0


def test_visible_rows(spark):
    e = make(spark, {}, {"owner": "bo"}, {"owner": "bo"})
    users = spark.createDataFrame([("ana", "user"), ("bo", "user"), ("eve", "user"), ("root", "admin"), ("bo2", "reviewer")], "viewer string, role string")
    assert {r["viewer"]: r["n"] for r in events.visible_counts(e, users).collect()} == {"ana": 1, "bo": 2, "eve": 0, "root": 3, "bo2": 3}
    assert events.visible(e).filter("scope = '*'").count() == 3


def test_local_days_become_bounds_on_the_scan(spark, tmp_path):
    e = make(spark, {"created_at": dt.datetime(2024, 5, 1, 18, 59)}, {"created_at": dt.datetime(2024, 5, 1, 19, 0)})
    e.write.parquet(str(tmp_path / "e"))
    found = events.search(spark.read.parquet(str(tmp_path / "e")), {"date_from": "2024-05-02", "date_to": "2024-05-02"}, "Asia/Karachi")
    assert [r["event_id"] for r in found.collect()] == [1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan


def test_diverse_selection(spark):
    rows = spark.createDataFrame([("c", f"g{g}", f"p{g}_{i}", 0) for g in range(10) for i in range(5)], "class_name string, group_id string, path string, priority int")
    got = dataset.diverse_selection(rows, 10).collect()
    assert len({r["group_id"] for r in got}) == 10 and len(got) == 10


def test_single_class_and_scores(spark):
    df = spark.createDataFrame([(["dog", "animal"],), (["dog", "cat"],), (["animal"],), (["x"],), (["dog", "music"],)], "labels array<string>")
    got = [r[0] for r in df.select(dataset.single_class("labels", {"dog": "Dog", "cat": "Cat"}, {"animal": "Animal"}, ["music"])).collect()]
    assert got == ["Dog", "ambiguous", "Animal", "unmapped", None]


def tone(seconds=1.0, hz=440.0, level=0.3, rate=16_000):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def clips(spark, *samples, rate=16_000):
    return spark.createDataFrame([(i, rate, [float(x) for x in s]) for i, s in enumerate(samples)], "clip_id long, rate int, samples array<float>")


def test_quality_grades(spark):
    rng = np.random.default_rng(0)
    burst = rng.normal(0, 0.003, 16_000).astype(np.float32)
    burst[6000:9000] += tone()[6000:9000]
    gaps = burst.copy()
    for s in (2000, 6000, 10_000):
        gaps[s : s + 800] = 0
    got = {r["clip_id"]: r for r in signals.assess(clips(spark, burst, np.zeros(16_000), tone(0.2), np.clip(burst * 10, -1, 1), gaps)).collect()}
    assert [got[i]["grade"] for i in range(5)] == ["Good", "Unusable", "Unusable", "Poor", "Poor"] and got[4]["dropouts"] == 3
    assert signals.assess(clips(spark, burst, rate=8000)).first()["grade"] == "Acceptable"


def test_segments_and_features(spark):
    parts = signals.segments(clips(spark, tone(2.2), tone(0.4))).collect()
    assert [(r["clip_id"], r["segment_no"]) for r in sorted(parts)] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]
    short = next(r for r in parts if r["clip_id"] == 1)
    assert short["padded"] and len(short["samples"]) == 16_000
    assert abs(signals.level_db(np.array(next(r for r in parts if r["clip_id"] == 0)["samples"])) + 20) < 0.1
    v = signals.feature_vector(tone(1.0, 1000.0), 16_000)
    assert v.shape == (123,) and np.isfinite(v).all() and signals.log_mel(tone(), 16_000).shape == (63, 64)
    centre = 20 + 20 + 20 + 24 + 16 + 2 + 3
    assert abs(v[centre] - 1000) < 60


def test_fingerprints_of_copies(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 0.1, 4000 * 4) * (1 + np.sin(np.arange(16_000) / 750))
    late = np.concatenate((np.zeros(2000), y))
    found = {r["clip_id"]: np.array(r["fingerprint"]).reshape(-1, 16) for r in signals.fingerprints(clips(spark, y, y * 0.5, np.zeros(4000), y[:500], late, rate=4000)).collect()}
    a, b = found[0], found[1]
    assert len(a) == 16 and neardup.best_correlation(a, b) > 0.99 and neardup.best_correlation(a, a[2:]) > 0.99 and neardup.best_correlation(a, a[:3]) == 0
    assert len(found[2]) == 0 and len(found[3]) == 0 and np.allclose(found[4], a, atol=1e-6)
    (one,) = signals.fingerprints(clips(spark, tone(1.0, signals.TONES[5], rate=4000), rate=4000)).collect()
    assert np.array(one["fingerprint"]).reshape(-1, 16).argmax(axis=1).tolist() == [5] * 4  # the tone's own band


def test_flatness_tells_noise_from_tones(spark):
    rng = np.random.default_rng(1)
    rows = signals.assess(clips(spark, rng.normal(0, 0.1, 8000), tone(0.5), np.cumsum(rng.normal(0, 0.01, 8000)), np.zeros(0), np.array([0.5, np.nan]))).collect()
    flat = {r["clip_id"]: r["flatness"] for r in rows}
    assert flat[0] > 0.98 and flat[1] < 0.01 and flat[2] < 0.1 and flat[3] is None and flat[4] is None
    assert {r["clip_id"]: r["grade"] for r in rows if r["clip_id"] > 2} == {3: "Unusable", 4: "Unusable"}


def endless(spark, n=4000, sessions=(1, 1, 1, 1, 1, 1, 1, 1, 1, 2)):
    """Windows of which nine in ten belong to one session, in many partitions; long runs cross them."""
    rng = np.random.default_rng(9)
    rows, t = [], 0
    for i in range(n):
        t += int(rng.choice((1, 1, 2, 5, 40)))
        name = "a" if i % 1500 < 900 else ("a", "b", "c")[int(rng.integers(3))]
        rows.append((sessions[i % len(sessions)], i, T0 + dt.timedelta(seconds=t), name, float(t), float(t + rng.integers(1, 30))))
    frame = spark.createDataFrame(rows, "session_id long, window_id long, seen_at timestamp, class_name string, s double, e double")
    return rows, frame.withColumn("confidence", F.lit(0.9)).repartition(8)


@pytest.fixture
def many_parts(spark):
    """Small range partitions stay what they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_along_one_endless_session(spark, many_parts):
    rows, frame = endless(spark)
    longest, spans, last, run = {}, [], {}, {}
    for k, i, _, c, s, e in rows:
        run[k] = run[k] + 1 if k in last and last[k][0] == c else 1
        longest[k, c] = max(longest.get((k, c), 0), run[k])
        if k in last and last[k][0] == c and s <= last[k][1]:
            at = last[k][2]
            spans[at][4:] = [e, spans[at][5] + 1]
        else:
            at = len(spans)
            spans.append([k, sum(x[0] == k for x in spans) + 1, c, s, e, 1])
        last[k] = (c, e, at)
    got = {(r["session_id"], r["class_name"]): r["longest"] for r in sequences.longest_run(frame, ["session_id"], ["seen_at", "window_id"], "class_name").collect()}
    assert got == longest and max(longest.values()) > 800
    found = sequences.event_spans(frame, "session_id", "s", "e", "class_name", "confidence", 0.5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, spans))
    parts = ordering.placed(frame, ["session_id"], ["seen_at", "window_id"]).groupBy("_part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2 * 4000 / 4  # a task has no more than its share


@pytest.mark.parametrize(("seconds", "chunk"), [(60, 1), (7, 100), (1000, 86_400)])
def test_episodes_equal_a_fold(spark, seconds, chunk):
    rows, frame = endless(spark, 1500)
    ends = [r for r in rows if r[1] % 23 == 5]
    alerting = [r for r in rows if r[1] % 23 != 5]
    steps = sorted([(k, c, t, 0) for k, _, t, c, _, _ in alerting] + [(k, c, t, 1) for k, _, t, c, _, _ in ends])
    out, opened = {}, {}
    for k, c, t, resolved in steps:
        if resolved:
            opened.pop((k, c), None)
            continue
        if (k, c) not in opened or (t - opened[k, c]).total_seconds() > seconds:
            opened[k, c] = t
        out[k, c, opened[k, c]] = out.get((k, c, opened[k, c]), 0) + 1
    got = sequences.alert_episodes(frame.filter("window_id % 23 <> 5"), seconds, resolutions=frame.filter("window_id % 23 = 5"), chunk_seconds=chunk).collect()
    assert {(r["session_id"], r["class_name"], r["started"]): r["windows"] for r in got} == out


def test_median_of_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("heavy", float(x)) for x in 10.0 ** rng.uniform(-9, 9, 1001)] + [("ties", float(x)) for x in rng.integers(0, 4, 500)] + [("one", 3.0), ("none", None)] + [("two", -1.5), ("two", 1e12)]
    got = {r["k"]: r["m"] for r in analytics.exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v", "m", buckets=8).collect()}
    want = {k: float(np.median([v for x, v in rows if x == k])) for k in ("heavy", "ties", "one", "two")}
    assert got == want


def test_diverse_selection_of_one_large_class(spark):
    """All groups of one class: the cut by counts gives what numbering all of them gives."""
    rows = spark.range(6000).select(F.lit("x").alias("class_name"), (F.col("id") % 2500).alias("group_id"), F.col("id").cast("string").alias("path"), (F.col("id") % 3).cast("int").alias("priority"))
    w = lambda *k: Window.partitionBy(*k)
    inside = rows.withColumn("round", F.row_number().over(w("class_name", "group_id").orderBy("priority", dataset.stable_order("42", "path"), "path")))
    plain = inside.withColumn("place", F.row_number().over(w("class_name").orderBy("round", "priority", dataset.stable_order("42", "group_id"), "group_id"))).filter("place <= 700")
    pick = lambda f: sorted((r["path"], r["place"]) for r in f.collect())
    assert pick(dataset.diverse_selection(rows, 700)) == pick(plain)


@pytest.mark.parametrize("n", [200, 20_000])
def test_near_duplicate_recall(spark, n):
    """Half the rows are changed copies at a correlation of about 0.9 to 0.96; found by the number of rows as well as by a few."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n // 2, 64))
    near = base + rng.normal(scale=rng.uniform(0.25, 0.5, size=(n // 2, 1)), size=base.shape)
    frame = pd.DataFrame({"id": np.arange(n), "f": np.concatenate((base, near)).tolist()})
    rows = spark.createDataFrame(frame, "id long, f array<double>").withColumn("d", F.col("id").cast("string"))
    got = {r["id"]: r["near_duplicate_of"] for r in neardup.near_duplicates(rows, "id", "f", "d").collect()}
    unit = lambda x: (x - x.mean(axis=1, keepdims=True)) / np.linalg.norm(x - x.mean(axis=1, keepdims=True), axis=1, keepdims=True)
    c = (unit(base) * unit(near)).sum(axis=1)
    want = {n // 2 + i for i in np.flatnonzero(c >= 0.9)}
    assert len(want) > n // 4 and len(want & set(got)) >= 0.99 * len(want)
    assert all(c[a - n // 2] >= 0.9 - 1e-6 for a, b in got.items() if b == a - n // 2)


def sounds(frames, fade, trimmed, n=120):
    """Recordings and copies of theirs with a tenth to a fifth of noise: detail from frame to frame or slow fades under it, the copy cut or whole."""
    rng = np.random.default_rng([frames, fade, trimmed])
    out = []
    for _ in range(n // 2):
        x = rng.normal(size=(frames, 16))
        if fade:
            level = sum(rng.normal() * np.cos(np.pi * k * (np.linspace(0, 1, frames) + rng.uniform(0, 0.1))) for k in range(1, 6))
            x = 3 * level[:, None] + x * rng.uniform(0.3, 1) + rng.normal(size=16)
        y = x + rng.normal(size=x.shape) * x.std() * rng.uniform(0.25, 0.47)
        if trimmed:
            first, rest = rng.integers(0, frames // 4 + 1, 2)
            y = y[first : len(y) - rest]
        out += [x, y]
    return out


@pytest.mark.parametrize(("frames", "fade", "trimmed"), [(4, True, False), (20, True, True), (80, False, True), (80, True, False), (80, True, True)])
def test_near_duplicates_of_long_recordings(spark, frames, fade, trimmed):
    """Every pair at every alignment, against the join: which recordings have an earlier partner, and the best score."""
    f = sounds(frames, fade, trimmed)
    rows = spark.createDataFrame([(i, x.ravel().tolist(), str(i)) for i, x in enumerate(f)], "k long, f array<double>, d string")
    got = {r["k"]: r["score"] for r in neardup.near_duplicates(rows, "k", "f", "d").collect()}
    best = {b: max((neardup.best_correlation(f[a], f[b]) for a in range(b)), default=0.0) for b in range(len(f))}
    want = {b: x for b, x in best.items() if x >= 0.9}
    assert len(want) > 30 and set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert sum(abs(want[b] - x) < 1e-8 for b, x in got.items()) >= 0.99 * len(want)


def test_near_duplicates_point_at_the_original(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=160)
    b, other = a + 0.1 * rng.normal(size=160), rng.normal(size=96)
    rows = [(1, a), (2, b), (3, a[32:]), (4, other), (5, b + 0.02 * rng.normal(size=160)), (6, np.zeros(160)), (7, a[:48]), (8, None), (9, a)]
    data = [(i, None if x is None else x.tolist(), "same" if i in (1, 9) else str(i)) for i, x in rows]
    found = neardup.near_duplicates(spark.createDataFrame(data, "k long, f array<double>, d string"), "k", "f", "d").collect()
    assert {r["k"]: r["near_duplicate_of"] for r in found} == {2: 1, 3: 1, 5: 1}
    assert neardup.near_duplicates(spark.createDataFrame([], "k long, f array<double>, d string"), "k", "f", "d").count() == 0


def test_transforms():
    y = tone()
    noisy = signals.mix(y, np.random.default_rng(0).normal(size=500).astype(np.float32), 10)
    assert abs(signals.level_db(y) - signals.level_db(noisy - y) - 10) < 0.01
    assert abs(signals.level_db(signals.reverberate(y, 16_000, 0.5, 0.3, np.random.default_rng(1))) - signals.level_db(y)) < 0.01
    assert np.abs(signals.soft_clip(y, 0.5)).max() < 0.5 * np.abs(y).max() and np.allclose(signals.soft_clip(y * 1e-3 + 0, 50.0), y * 1e-3, rtol=1e-3)
    assert signals.shift(np.arange(4.0), 9).tolist() == [0, 0, 0, 0]
    assert signals.shift(np.arange(4.0), 1).tolist() == [0, 0, 1, 2] and signals.shift(np.arange(4.0), -1).tolist() == [1, 2, 3, 0]
    assert signals.level_db(signals.pass_band(tone(1.0, 5000.0), 16_000, 300, 3400)) < -60


def wav(path, samples, rate=16_000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())


def test_audio_tree(spark, tmp_path):
    wav(tmp_path / "raw" / "dog" / "a.wav", tone())
    (tmp_path / "raw" / "dog" / "bad.wav").write_bytes(b"junk")
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.scan_audio(spark, str(tmp_path / "raw")).collect()}
    assert found["a.wav"]["label"] == "dog"
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.probe_audio(spark, str(tmp_path / "raw")).collect()}
    assert got["a.wav"]["duration_s"] == 1.0 and got["a.wav"]["bit_depth"] == 16 and got["bad.wav"]["error"]


def test_dataset_is_not_overwritten(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 1)], "split string, class_name string, n int")
    files.write_dataset(rows, str(tmp_path / "d"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_dataset(rows, str(tmp_path / "d"))
    files.write_dataset(rows, str(tmp_path / "d"), force=True)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,name\n1,\"a, \"\"b\"\"\"\nx,c\n", encoding="utf-8")
    got = [tuple(r) for r in files.read_metadata(spark, str(tmp_path / "m.csv"), "id int, name string, more double").collect()]
    assert got == [(1, 'a, "b"', None), (None, "c", None)]


def streamed(spark, tmp_path, df, parts=3):
    df.repartition(parts).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


LIVE = "session_id long, window_id long, ts timestamp, python_class string, python_confidence double, python_margin double, gtm_class string, gtm_confidence double, quality_grade string, n_windows int, noise_dbfs double, overlaps array<string>, duration_s double, bytes long, silent boolean"


def live_rows(spark, names, step=2, **changes):
    base = {"confidence": 0.95, "grade": "Good", "duration": 1.0, "silent": False}
    rows = []
    for i, n in enumerate(names):
        x = {**base, **{k: v[i] for k, v in changes.items() if i in v}}
        rows.append((1, i, T0 + dt.timedelta(seconds=step * i), n, x["confidence"], 0.5, n, 0.9, x["grade"], 1, None, [], x["duration"], 1000, x["silent"]))
    return spark.createDataFrame(rows, LIVE)


def live(spark, stream, **options):
    with jobs.with_state_store(spark):
        return jobs.run_available(jobs.live_sessions(stream, rule_table(spark), **options))


@pytest.mark.parametrize("parts", [1, 4])
def test_live_sessions(spark, tmp_path, parts):
    """Several micro-batches give what one does: repeats, decision, alert, whether the audio is kept."""
    rows = live_rows(
        spark, ["Glass Breaking", "Glass Breaking", "Background Noise", "Machinery Fault", "Animal Sound", "Machinery Fault", "Machinery Fault", "Vehicle Horn", "Glass Breaking"],
        silent={4: True}, duration={1: 0.1}, confidence={7: 0.4}, step=2,
    )
    for b in range(parts):  # files in time order, one a batch
        rows.filter(f"window_id * {parts} div 9 = {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["window_id"]: (r["repeats"], r["alert_status"], r["alert"], r["keep_audio"]) for r in live(spark, stream).collect()}
    assert got == {
        0: (0, "Alert generated", "new", True), 2: (0, "No alert", "", False), 3: (0, "Not confirmed", "", True), 5: (1, "Alert generated", "new", True), 6: (2, "Alert generated", "ongoing", True),
        7: (0, "No alert", "", True), 8: (0, "Alert generated", "ongoing", True),
    }


def test_live_stream_equals_batch_jobs(spark):
    """The stream's repeats and alerts are those of the batch jobs over the stored windows."""
    names = ["Glass Breaking", "Gunshot", "Background Noise", "Machinery Fault"]
    rng = np.random.default_rng(5)
    rows = live_rows(spark, [names[k] for k in rng.integers(0, 4, 120)], step=3)
    folder = tempfile.mkdtemp()
    rows.coalesce(1).write.mode("append").parquet(folder + "/in")
    stream = spark.readStream.schema(rows.schema).parquet(folder + "/in")
    got = settled(live(spark, stream))
    batch = {r["window_id"]: r["repeats"] for r in sequences.repeats_in_period(rows.withColumnsRenamed({"ts": "seen_at", "python_class": "class_name"}), 10).collect()}
    assert {r["window_id"]: r["repeats"] for r in got.collect()} == batch
    alerting = rows.join(got.filter("alert <> ''").select("window_id"), "window_id").withColumnsRenamed({"ts": "seen_at", "python_class": "class_name"})
    episodes = sorted((r["class_name"], r["windows"]) for r in sequences.alert_episodes(alerting, 60).collect())
    opened = got.filter("alert <> ''").groupBy("class_name", "started").count().collect()
    assert episodes == sorted((r["class_name"], r["count"]) for r in opened) and len(episodes) > 5


def test_session_stream_equals_batch(spark, tmp_path):
    far = spark.createDataFrame([(99, 0, T0 + dt.timedelta(days=30), "x", False, False)], "session_id long, window_id long, seen_at timestamp, class_name string, alerting boolean, silent boolean")
    rows = windows(spark, *["a"] * 9, step=100).unionByName(far)
    stream = streamed(spark, tmp_path, rows.withColumnRenamed("seen_at", "ts").repartition(1), 1)
    got = {tuple(r) for r in jobs.run_available(jobs.stream_sessions(stream, "5 minutes")).collect()}
    want = {(r["session_id"], r["started"], r["ended"], r["windows"]) for r in sequences.session_totals(rows, "5 minutes").collect()}
    assert got <= want and {g[0] for g in got} == {1}


def test_escalation_stream(spark, tmp_path):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    steps = [(1, m(0), "created", 2.0), (2, m(0), "created", 2.0), (2, m(1), "acknowledge", None), (3, m(0), "created", None), (9, m(300), "created", None)]
    df = spark.createDataFrame(steps, "alert_id long, ts timestamp, kind string, minutes double").coalesce(1)
    got = [(r["alert_id"], r["due"]) for r in jobs.run_available(jobs.escalations(streamed(spark, tmp_path, df, 1))).collect()]
    assert got == [(1, m(2))]


def test_stream_dedup_drops_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([("k", T0), ("k", T0 + dt.timedelta(minutes=1)), ("j", T0)], "key string, ts timestamp")
    assert jobs.run_available(jobs.first_of_each(streamed(spark, tmp_path, rows), "key")).count() == 2


def test_codes_keep_long_numbers(spark):
    rows = spark.createDataFrame([(7,), (123456,), (1234567,), (None,)], "n long")
    assert [r[0] for r in rows.select(code("ALR", "n")).collect()] == ["ALR-000007", "ALR-123456", "ALR-1234567", None]
    start = spark.createDataFrame([("Gunshot", 99_999)], "label string, last_no long")
    one = spark.createDataFrame([("Gunshot", "a")], "label string, path string")
    assert dataset.class_codes(one, ["path"], "label", start).first()["audio_id"] == "GUN-100000"


def test_probes_tell_leaks_from_chance(spark):
    spark._jsparkSession.observationManager()  # a session with state: it can't be serialised with a model any more
    rng = np.random.default_rng(2)
    rows = [(str(i), i % 3, i % 2, i % 41, [float(i % 2), float(rng.normal())]) for i in range(240)]  # the first feature is the source
    df = spark.createDataFrame(rows, "key string, y int, source int, group_id int, features array<double>")
    got = learning.source_probe(df, folds=3).collect()
    assert len(got) == 3 and all(r["accuracy"] > 0.95 and r["majority"] == 0.5 for r in got)
    folds = learning.shortcut_probe(df, folds=3).collect()
    assert sum(r["n"] for r in folds) == 180 and all(abs(r["chance"] - 1 / 3) < 1e-9 for r in folds) and sum(r["correct"] for r in folds) / 180 < 0.6
    assert learning.source_probe(df.filter("source = 0"), folds=3).count() == 0


def test_sliding_counts_in_steps_hold_less_state(spark, tmp_path):
    """Two steps give the windows of one, from a row per key and step in place of one per row and window."""
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(3)), T0 + dt.timedelta(seconds=int(s))) for s in np.sort(rng.integers(0, 7200, 3000))]
    df = spark.createDataFrame([*rows, (9, T0 + dt.timedelta(days=1))], "k long, ts timestamp").coalesce(1)
    one = {tuple(r) for r in jobs.run_available(jobs.sliding_counters(streamed(spark, tmp_path / "a", df, 1), "k", 60, 5, 1)).collect()}
    two = {tuple(r) for r in jobs.run_available(jobs.sliding_in_steps(streamed(spark, tmp_path / "b", df, 1), ["k"], 60, 5, 1)).collect()}
    assert one == two and len(one) > 50


def test_pages_by_cursor(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i // 7)) for i in range(100)]  # many rows of one moment
    spark.createDataFrame(rows, "n long, at timestamp").repartition(3).write.parquet(str(tmp_path / "t"))
    df, order, cursor, seen = spark.read.parquet(str(tmp_path / "t")), [("at", True), ("n", False)], None, []
    while got := events.page_after(df, order, cursor, 9).collect():
        seen += [r["n"] for r in got]
        cursor = (got[-1]["at"], got[-1]["n"])
    assert seen == [i for i, t in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    plan = events.page_after(df, order, (T0, 3), 9)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(at," in plan and "TakeOrderedAndProject" in plan


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    frame = lambda *rows: spark.createDataFrame(list(rows), "part string, n long")
    read = lambda v=None: sorted(((r["part"], r["n"]) for r in versions.read_version(spark, path, v).collect()), key=str)
    assert versions.latest_version(spark, path) == 0
    assert versions.publish(frame(("a", 1), ("b", 2), (None, 3), ("", 4)), path, "part") == 1
    assert versions.publish(frame(("a", 5)), path, "part") == 2
    reader = versions.read_version(spark, path)
    assert versions.publish(frame((None, 6), ("b", 7)), path, "part", replace=True) == 3
    assert versions.drop_parts(spark, path, ["a", None]) == 4
    assert read(1) == sorted([("a", 1), ("b", 2), (None, 3), ("", 4)], key=str)
    assert read(2) == sorted([*read(1), ("a", 5)], key=str) == sorted(((r["part"], r["n"]) for r in reader.collect()), key=str)
    assert read(3) == sorted([("a", 1), ("a", 5), (None, 6), ("b", 7), ("", 4)], key=str) and read() == [("", 4), ("b", 7)]
    with pytest.raises(versions.VersionConflict):  # the second of two writers on version 3
        versions.publish(frame(("z", 1)), path, "part", base=3)
    broken = frame(("q", 1)).select("part", F.raise_error(F.lit("no")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        versions.publish(broken, path, "part")
    with pytest.raises(ValueError, match="differ"):
        versions.publish(frame(("q", 1)).select("n", "part"), path, "n")
    assert versions.latest_version(spark, path) == 4 and read() == [("", 4), ("b", 7)]
    assert versions.publish(frame(), path, "part") == 5 and read() == [("", 4), ("b", 7)]


def test_comparison_text_tells_every_part(spark):
    schema = "event_id long, python_class string, python_confidence double, gtm_class string, gtm_confidence double, reference_class string, window_classes array<string>, quality_grade string, quality_issues array<string>, alert_status string, final_class string, severity string, review_reasons array<string>"
    rows = [
        (1, "Gunshot", 0.9, "Alarm", 0.4, "Gunshot", ["Alarm", "Gunshot", "Gunshot", "x", "y", None], "Poor", ["Noise"], "Alert generated", "Gunshot", "Critical", ["Low Confidence"]),
        (2, "Gunshot", 0.9, "Background Noise", 0.8, "Alarm", ["Gunshot"], "Good", [], "No alert", "Gunshot", "High", []),
        (3, "Gunshot", 0.9, "Gunshot", 0.8, "Alarm", None, None, None, "No alert", "Gunshot", "High", None), (4, "Gunshot", 0.9, "Siren", 0.8, "Siren", None, None, None, None, None, None, None),
    ]
    pairs = spark.createDataFrame([("Alarm", "Gunshot", "both are loud")], "class_a string, class_b string, why string")
    got = {r["event_id"]: r["explanation"] for r in text.comparison_text(spark.createDataFrame(rows, schema), pairs).collect()}
    assert got == {
        1: "First: Gunshot (90%), second: Alarm (40%), actual: Gunshot; first right; often mixed up: both are loud; windows differ: Gunshot in 2, Alarm in 1, x in 1; quality Poor: noise; second model unsure; alert: Critical Gunshot; review: low confidence",
        2: "First: Gunshot (90%), second: Background Noise (80%), actual: Alarm; both wrong; faint events and noise are hard to tell apart",
        4: "First: Gunshot (90%), second: Siren (80%), actual: Siren; second right; the models hear different recordings of the sound",
    }


def test_messages_survive_a_restart(spark, tmp_path, monkeypatch):
    """Files that come later, and a batch that fails half way: nothing is lost and nothing comes twice."""
    say = lambda *ids: [f'{{"session_id":1,"window_id":{i},"seen_us":{i},"duration_s":1.0,"bytes":9}}' for i in ids] + [f"broken {ids[0]}"]
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    write = lambda name, *ids: (folder / name).write_text("\n".join(say(*ids)) + "\n")
    read = lambda pair: (sorted(r["window_id"] for r in pair[0].collect()), sorted(r["value"] for r in pair[1].collect()))
    write("a", 1, 2)
    assert read(messages.take_messages(spark, str(folder), out, files=1)) == ([1, 2], ["broken 1"])
    write("b", 3, 4)
    write("c", 5)
    whole = messages.parse_messages
    monkeypatch.setattr(messages, "parse_messages", lambda lines: whole(lines).withColumn("bytes", F.when(F.col("window_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("bytes"))))
    with pytest.raises(Exception, match="lost"):
        messages.take_messages(spark, str(folder), out, files=1)
    monkeypatch.setattr(messages, "parse_messages", whole)
    for _ in range(2):
        assert read(messages.take_messages(spark, str(folder), out, files=1)) == ([1, 2, 3, 4, 5], ["broken 1", "broken 3", "broken 5"])


def test_payloads_may_be_read_whole(spark):
    windows = ",".join(f'{{"start":{i},"end":{i + 1},"probs":[{0.5 if i < 2500 else 7},0.5]}}' for i in range(2501))
    df = spark.createDataFrame([(f'{{"labels":["a","b"],"clip":[0.5,0.5],"windows":[{windows}]}}',)], "p string")
    few, whole = df.select(F.size(dataset.parse_scores("p")["windows"]), dataset.parse_scores("p", None)["error"]).first()
    assert (few, whole) == (2000, "not probabilities")


def test_a_new_stream_takes_over_running_sessions(spark, tmp_path):
    """One run, ten batches, and a second stream that starts from a table of the first one's sessions tell the same."""
    names = ["Glass Breaking", "Gunshot", "Background Noise", "Machinery Fault"]
    rng = np.random.default_rng(8)
    rows = live_rows(spark, [names[k] for k in rng.integers(0, 4, 60)], step=3).withColumn("session_id", F.col("window_id") % 2)

    def run(name, part, parts, **options):
        first, last = part.agg(F.min("window_id"), F.max("window_id")).first()
        step = (last - first + parts) // parts
        for b in range(parts):
            part.filter(F.col("window_id").between(first + b * step, first + (b + 1) * step - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return settled(live(spark, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)), **options))

    tell = lambda f: sorted(map(str, f.collect()))
    whole = run("one", rows, 1)
    assert tell(run("ten", rows, 10)) == tell(whole) and whole.count() == 60
    before = run("first", rows.filter("window_id < 31"), 2)
    running = jobs.session_state(before.join(rows.select("window_id", "ts"), "window_id"))
    after = run("second", rows.filter("window_id >= 31"), 2, running=running)
    assert tell(before.unionByName(after)) == tell(whole)


def test_a_live_session_asks_its_state_store_at_most_four_times_a_batch():
    """Read, write and move the timer, however many windows and alert classes a session has."""
    calls, kept = [], {}

    class Store:
        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return kept.get("v")

        def update(self, value):
            calls.append("update")
            kept["v"] = value

        def registerTimer(self, ms):
            calls.append("register")

        def deleteTimer(self, ms):
            calls.append("delete")

    session, timers = jobs._LiveSession(1, 10.0, 60.0, True), TimerValues(0, 0)
    session.init(Store())
    names = ["Gunshot", "Glass Breaking", "Vehicle Horn", "Machinery Fault"]
    for batch in range(2):
        del calls[:]
        at = [T0 + dt.timedelta(seconds=batch * 20 + i) for i in range(8)]
        rows = [Row(window_id=batch * 8 + i, ts=t.replace(tzinfo=dt.UTC), stored=True, python_class=names[i % 4], final_class=names[i % 4], times=1, alert_status="Alert generated", severity="High", review=False) for i, t in enumerate(at)]
        told = list(session.handleInputRows((5,), iter(rows), timers))
        assert [r["alert"] for r in told] == (["new"] * 4 if batch == 0 else ["ongoing"] * 4) + ["ongoing"] * 4
        assert told[-1]["windows"] == batch * 8 + 8 and len(calls) <= 4


def test_near_duplicates_keep_no_buckets(spark, monkeypatch):
    """Buckets of a few tables at a time are shuffled and dropped; only their pairs and the sizes of large ones are kept, and the setting is as before."""
    kept, made, key = [], [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    write, buckets, before = neardup.settled, neardup._bucketed, spark.conf.get(key)
    monkeypatch.setattr(neardup, "settled", lambda df: kept.append(df.columns) or write(df))
    monkeypatch.setattr(neardup, "_bucketed", lambda *given: made.append(given[-1]) or buckets(*given))
    rng = np.random.default_rng(4)
    f = [rng.standard_normal(16 * n) for n in (6, 6, 8, 8)]
    rows = [(i, x.tolist(), str(i)) for i, x in enumerate([*f, f[0] * 1.5 + 0.01 * rng.standard_normal(96), f[2][16:112]])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "id long, f array<double>, d string"), "id", "f", "d").collect()
    assert sorted((r["id"], r["near_duplicate_of"]) for r in got) == [(4, 0), (5, 2)]
    assert not [c for c in kept if "role" in c] and spark.conf.get(key) == before
    assert len(made) > 1 and all(len(t) <= neardup.TABLES for t in made) and [t for r in made for t in r] == list(range(made[-1].stop))


def test_noise_is_joined_no_longer_than_its_clip(spark):
    """A long noise clip is not carried whole beside every short clip, and the mixed samples are those of the whole one."""
    rng = np.random.default_rng(6)
    noise, clips = rng.integers(0, 255, 5000).astype(np.uint8), [rng.integers(0, 255, n).astype(np.uint8) for n in (40, 7000, 0)]
    bank = spark.createDataFrame([(9, bytearray(noise.tobytes()))], "clip_id long, samples binary")
    given = spark.createDataFrame([(i, 16_000, bytearray(c.tobytes()), 9) for i, c in enumerate(clips)], "clip_id long, rate int, samples binary, partner_id long")
    joined = signals._with_noise(given, bank)
    assert {r["clip_id"]: len(r["noise"]) for r in joined.collect()} == {0: 40, 1: 5000, 2: 0}
    floats = lambda name: F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: i.cast("float"))
    listed = signals._with_noise(given.filter("clip_id < 2").withColumn("samples", floats("samples")), bank.withColumn("samples", floats("samples")))
    assert {r["clip_id"]: len(r["noise"]) for r in listed.collect()} == {0: 40, 1: 5000}
    for r in signals.stressed(given, bank).filter("condition = 'noise 10'").collect():
        y = signals._decoded(clips[r["clip_id"]].tobytes())
        assert np.allclose(r["samples"], signals.mix(y, signals._decoded(noise.tobytes()), 10.0), atol=1e-6)


def test_tree_search_beats_a_linear_model(spark):
    """Classes told by the quadrant of two features: no linear model can, trees do; the search halves its trials."""
    spark._jsparkSession.observationManager()  # a session with state, as in the probes
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (600, 3))
    rows = [(i, int((a > 0) != (b > 0)), [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "i long, y int, features array<double>")
    train, validation = df.filter("i % 3 > 0"), df.filter("i % 3 = 0")
    _, table = learning.search_trees(train, validation, 2, trials=4, trees=2, most=8)
    trials = sorted(table.collect(), key=lambda r: (r["rung"], r["trial"]))
    _, linear = learning.train_tuned(train, validation, 2, strengths=(0.001,))
    assert max(r["macro_f1"] for r in trials) > 0.9 > 0.7 > linear.first()["macro_f1"]
    by_rung = {k: [r for r in trials if r["rung"] == k] for k in {r["rung"] for r in trials}}
    assert len(by_rung[0]) == 4 and {r["trees"] for r in by_rung[0]} == {2} and all(len(by_rung[k]) <= len(by_rung[k - 1]) // 2 for k in by_rung if k)
    assert learning.sampled_settings(4, 0) == learning.sampled_settings(8, 0)[:4]


def test_results_of_signal_jobs_leave_a_worker_in_pieces():
    """A batch of clips that makes 40 MB of results holds no more than a few of them at once."""

    class Table:
        def mapInPandas(self, run, schema):
            return run

    run = signals._map(Table(), "clip_id long, n int, samples array<float>", lambda r, y: ((r.clip_id, n, np.resize(y, 100_000)) for n in range(10)))
    batch = pd.DataFrame({"clip_id": range(10), "rate": 16_000, "samples": [b"some text"] * 10})
    pieces = list(run(iter([batch, batch.iloc[:0]])))
    assert max(sum(x.nbytes for x in p["samples"]) for p in pieces) <= signals.HELD_BYTES + 400_000
    assert [(i, n) for p in pieces for i, n in zip(p["clip_id"], p["n"], strict=True)] == [(i, n) for i in range(10) for n in range(10)]


def test_escalations_join_without_python(spark, tmp_path):
    """An action before the alert or before its due time counts, one at the due time doesn't; no task per alert runs in Python."""
    m = lambda k: T0 + dt.timedelta(minutes=k)
    steps = [(1, m(0), "created", 2.0), (1, m(2), "acknowledge", None), (2, m(5), "created", 2.0), (2, m(1), "acknowledge", None), (3, m(0), "created", 1.0), (3, m(0), "note", None), (4, m(288), "created", 2.0), (5, m(289), "created", 2.0), (9, m(300), "note", None)]
    df = spark.createDataFrame(steps, "alert_id long, ts timestamp, kind string, minutes double").coalesce(1)
    told = jobs.escalations(streamed(spark, tmp_path, df, 1))
    assert "Python" not in told._jdf.queryExecution().analyzed().toString() and "InPandas" not in told._jdf.queryExecution().analyzed().toString()
    assert sorted((r["alert_id"], r["due"]) for r in jobs.run_available(told).collect()) == [(1, m(2)), (4, m(290))]


def test_near_duplicates_of_all_pairs(spark, monkeypatch):
    """With a recall of 1 every pair of several blocks and lengths counts, without buckets; the score is not rounded on the way."""
    monkeypatch.setattr(neardup, "_bucketed", None)
    monkeypatch.setattr(neardup, "RECORDINGS", 16)
    rng = np.random.default_rng(8)
    base = [rng.standard_normal((n, 16)) for n in (6, 8, 12, 8, 6, 12) for _ in range(4)]
    f = [*base, *(x + 0.3 * rng.standard_normal(x.shape) for x in base), *(2 * x[1:7] for x in base), *base[:3], np.ones((8, 16)), np.full((6, 16), np.nan)]
    rows = [(i, x.ravel().tolist(), str(i)) for i, x in enumerate(f)]
    frame = spark.createDataFrame([*rows, (99, rows[0][1], "0"), (100, None, "x"), (101, rows[0][1][:48], "y")], "k long, f array<double>, d string").repartition(5)
    got = {r["k"]: (r["near_duplicate_of"], r["score"]) for r in neardup.near_duplicates(frame, "k", "f", "d", recall=1.0).collect()}
    want = {}
    for b in range(len(f)):
        score, minus = max(((round(x, 9), -a) for a in range(b) if (x := neardup.best_correlation(f[a], f[b])) >= 0.9), default=(0.0, 0))
        if score:
            want[b] = (want.get(-minus, (-minus,))[0], neardup.best_correlation(f[-minus], f[b]))
    assert len(want) > 40 and {b: a for b, (a, _) in got.items()} == {b: a for b, (a, _) in want.items()}
    assert all(abs(got[b][1] - want[b][1]) < 1e-14 for b in want)


def test_fingerprints_take_bytes_and_odd_clips(spark):
    """Bytes and arrays of one sound have one fingerprint, to the tone's formula; broken clips and clips without a rate have none, others beside them stay."""
    rng = np.random.default_rng(2)
    b = rng.integers(0, 255, 1300).astype(np.uint8)
    y = signals._decoded(b.tobytes()).astype(float)
    got = lambda rows, kind: {r["clip_id"]: (r["frames"], r["fingerprint"]) for r in signals.fingerprints(spark.createDataFrame(rows, f"clip_id string, rate int, samples {kind}")).collect()}
    arrays = got([("a", 2000, y.tolist()), ("null", 2000, None), ("short", 2000, y[:499].tolist()), ("nan", 2000, [0.5] * 500 + [float("nan")]), ("hole", 2000, [0.5, None] * 500), ("rate", None, y.tolist()), ("quiet", 2000, [0.0] * 1000)], "array<double>")
    told = got([("a", 2000, bytearray(b.tobytes()))], "binary")
    p = y[:1000].reshape(2, 500)
    want = [10 * np.log10((sum(v * np.cos(2 * np.pi * hz / 2000 * t) for t, v in enumerate(x)) ** 2 + sum(v * np.sin(2 * np.pi * hz / 2000 * t) for t, v in enumerate(x)) ** 2) / 250_000 + 1e-10) for x in p for hz in signals.TONES]
    assert told["a"] == arrays["a"] and told["a"][0] == 2 and np.allclose(told["a"][1], np.array(want) - np.mean(want), atol=1e-9)
    assert arrays["null"] == arrays["short"] == arrays["quiet"] == (0, []) and arrays["nan"] == arrays["hole"] == arrays["rate"] == (None, None)


def test_stress_levels_without_samples(spark):
    """The query's levels leave a worker without samples and are those of the copies; echoes are drawn and added as one by one."""
    rng = np.random.default_rng(3)
    noise, sounds = rng.integers(0, 255, 700).astype(np.uint8), [rng.integers(0, 255, n).astype(np.uint8) for n in (0, 1, 499, 20_000)]
    bank = spark.createDataFrame([(9, bytearray(noise.tobytes()))], "clip_id long, samples binary")
    given = spark.createDataFrame([(i, 16_000, bytearray(c.tobytes()), 9) for i, c in enumerate(sounds)], "clip_id long, rate int, samples binary, partner_id long")
    bare = signals.stressed(given, bank, with_samples=False)
    whole = {(r["clip_id"], r["condition"]): r for r in signals.stressed(given, bank).collect()}
    assert bare.columns == ["clip_id", "condition", "level"] and len(whole) == len(sounds) * len(signals.CONDITIONS)
    assert {(r["clip_id"], r["condition"]): r["level"] for r in bare.collect()} == {k: r["level"] for k, r in whole.items()}

    def echoed(y, seconds, wet, rng):
        echoes, reach = np.zeros(y.size), int(seconds * 16_000)
        for delay in rng.integers(1, reach, 64):
            loudness = rng.choice((-1.0, 1.0)) * 10 ** (-3.0 * delay / reach)
            echoes[delay:] += loudness * y[: max(y.size - delay, 0)]
        loud = signals.level_db(y)
        at = lambda share: loud + 10 * np.log10(share)
        return signals.at_level(signals.at_level(y, at(1 - wet)) + signals.at_level(echoes, at(wet)), loud)

    for i, c in enumerate(sounds):
        y, of = signals._decoded(c.tobytes()), lambda name: whole[i, name]["samples"]  # noqa: B023
        assert np.array_equal(of("clean"), y)
        if y.size:
            assert np.array_equal(of("echo"), echoed(y, 0.8, 0.5, np.random.default_rng(i * 31 + 5)).astype(np.float32))
            far = 0.5 * echoed(signals.pass_band(y, 16_000, 0, 4000), 0.6, 0.3, np.random.default_rng(i * 31 + 8))
            assert np.array_equal(of("distant"), far.astype(np.float32))
