"""Classes, alert rules and thresholds: small dimensions of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ordered grades, classes and the alert rules.
SEVERITIES = ("Informational", "Low", "Medium", "High", "Critical")
GRADES = ("Good", "Acceptable", "Poor", "Unusable")
UNKNOWN, BACKGROUND = "Unknown", "Background Noise"
NON_EVENTS = ("Background Noise", "Normal Machinery")
#: category, critical, alert, severity, alert type, confidence, margin, repeats, worst grade, minutes to escalation, what to do
RULES = (
    ("Gunshot", True, True, "Critical", "security", 0.5, 0.15, 2, "Poor", 2.0, "call security, keep people away"),
    ("Glass Breaking", True, True, "High", "security", 0.5, 0.1, 1, "Poor", 5.0, "inspect windows and doors"),
    ("Panic Scream", True, True, "Critical", "security", 0.45, 0.1, 1, "Poor", 2.0, "send first aid and security"),
    ("Aggression", True, True, "High", "security", 0.45, 0.1, 1, "Poor", 5.0, "security intervenes"),
    ("Person Asking for Help", True, True, "Critical", "security", 0.5, 0.1, 1, "Poor", 2.0, "send the nearest person"),
    ("Alarm or Siren", False, True, "High", "attention", 0.55, 0.1, 2, "Poor", 10.0, "follow the alarm procedure"),
    ("Machinery Fault", False, True, "High", "maintenance", 0.55, 0.1, 2, "Acceptable", 30.0, "inspect the machine"),
    ("Vehicle Horn", False, False, "Low", "traffic", 0.5, 0.1, 1, "Poor", None, "nothing to do"),
    ("Animal Sound", False, False, "Low", "environment", 0.5, 0.1, 1, "Poor", None, "check if unexpected"),
    ("Normal Machinery", False, False, "Informational", "maintenance", 0.5, 0.1, 1, "Poor", None, "nothing to do"),
    ("Background Noise", False, False, "Informational", "environment", 0.5, 0.1, 1, "Poor", None, "nothing to do"),
    ("Unknown", False, False, "Informational", "environment", 0.0, 0.0, 1, "Poor", None, "listen to it"),
)
#: category: confidence and repeats from which a High alert becomes Critical
RAISE_TO_CRITICAL = {"Aggression": (0.85, 3)}
#: category: level in dBFS above which severity, alert and action change
NOISE_LIMITS = {"Background Noise": (-20.0, "Medium", True, "look for a disturbance nearby")}
MIN_CONFIDENCE, TOP_TWO_MARGIN, WEAK_DIFFERENCE, OVERLAP, UNKNOWN_BELOW = 0.5, 0.1, 0.3, 0.25, 0.35

#: What a category without an enabled rule gets.  Fixed values.
DEFAULTS = {
    "critical": False, "alert": False, "severity": "Informational", "alert_type": "environment", "min_confidence": 0.6, "top_two_margin": 0.15,
    "consecutive_detections": 1, "min_quality": "Poor", "recommended_action": "", "require_model_agreement": False, "enabled": True,
}
RULE_SCHEMA = (
    "category string, critical boolean, alert boolean, severity string, alert_type string, min_confidence double, top_two_margin double, "
    "consecutive_detections int, min_quality string, escalate_after_minutes double, recommended_action string, require_model_agreement boolean, "
    "enabled boolean, raise_confidence double, raise_repeats int, noise_limit_dbfs double, noise_severity string, noise_alert boolean, noise_action string"
)
#: How a rule is written as JSON; other names, such as those that begin with _, are comments.
_JSON = (
    "category string, critical boolean, alert boolean, severity string, alert_type string, min_confidence double, top_two_margin double, "
    "consecutive_detections int, min_quality string, escalate_after_minutes double, recommended_action string, require_model_agreement boolean, enabled boolean, "
    "raise_to_critical struct<min_confidence: double, consecutive_detections: int>, noise_limit_dbfs double, "
    "above_noise_limit struct<severity: string, alert: boolean, recommended_action: string>"
)


def _rows() -> list[tuple]:
    return [(*r, False, True, *RAISE_TO_CRITICAL.get(r[0], (None, None)), *NOISE_LIMITS.get(r[0], (None,) * 4)) for r in RULES]


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a DataFrame of a dozen rows."""
    return spark.createDataFrame(_rows(), RULE_SCHEMA)


def rule_sql() -> str:
    """The rules as SQL VALUES."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in _rows())
    names = ", ".join(c.split()[0] for c in RULE_SCHEMA.split(", "))
    return f"(SELECT * FROM (VALUES {rows}) AS r({names}))"


def parse_rules(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rule rows of JSON texts, one rule or an array of rules a text; keys left out take the defaults, unknown ones are skipped.

    A text that is no JSON, or has no category, gives no row.
    """
    parsed = F.from_json(column, f"array<struct<{_JSON}>>")  # one object counts as an array of one
    r = texts.select(F.explode(parsed).alias("r")).filter("r.category IS NOT NULL").select("r.*")
    flat = {
        "raise_confidence": F.when(F.col("raise_to_critical").isNotNull(), F.coalesce("raise_to_critical.min_confidence", F.lit(1.0))),
        "raise_repeats": F.when(F.col("raise_to_critical").isNotNull(), F.coalesce("raise_to_critical.consecutive_detections", F.lit(1))),
        "noise_severity": F.col("above_noise_limit.severity"),
        "noise_alert": F.col("above_noise_limit.alert"),
        "noise_action": F.col("above_noise_limit.recommended_action"),
    }
    filled = r.withColumns(flat).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return filled.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in RULE_SCHEMA.split(", ")))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON file {"rules": [...]}; every file below path is read whole."""
    texts = spark.read.text(path, wholetext=True)
    return parse_rules(texts.select(F.get_json_object("value", "$.rules").alias("value")))


def rank(column: Column | str, order: tuple[str, ...]) -> Column:
    """Position of a value in an ordered list; -1 for anything else."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(column) if isinstance(column, str) else column) - 1


def rank_sql(column: str, order: tuple[str, ...]) -> str:
    return "CASE " + column + "".join(f" WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + " ELSE -1 END"


def with_rule(df: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """df with its category's rule in columns rule_*; a missing or disabled rule gives the defaults.

    rules holds one row per class.  It is broadcast only while it has at most
    10,000 rows.
    """
    named = rules.filter("enabled").select(F.col("category").alias(category), *(F.col(c).alias(f"rule_{c}") for c in rules.columns if c not in ("category", "enabled")))
    few = rules.limit(10_001).count() <= 10_000
    joined = df.join(F.broadcast(named) if few else named, category, "left")
    return joined.withColumns({f"rule_{c}": F.coalesce(F.col(f"rule_{c}"), F.lit(v)) for c, v in DEFAULTS.items() if c != "enabled"})
