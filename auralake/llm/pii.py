"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Strict detectors give the base spans (email, ip, card, phone), which always
stay.  A loose generator proposes further spans (long mixed tokens, long digit
groups); labelers vote for, against, or abstain: a regex of known forms, a
gazetteer of issuers' prefixes and countries' number formats, the words and
signs before the span, its characters, and a checksum.  Spark counts the
patterns of votes and span features over all documents.  For each kind,
expectation-maximisation on the votes (as many as there are patterns, not
documents) estimates how often each labeler is right; with these labels a
logistic span classifier is trained on votes and span features together, and
its decision per pattern is applied to every proposed span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.storage import TEXT_BATCH, discard, id_long, id_text, materialise

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "number")
#: Words that name personal data or secrets shortly before them.
CONTEXT = (
    "account", "api", "auth", "bearer", "card", "contact", "credential", "email", "iban", "id", "ip", "key", "login",
    "mail", "mobile", "passport", "passwd", "password", "phone", "pin", "secret", "ssn", "tel", "token", "user",
)
#: Gazetteer: how issuers begin their keys and tokens.
ISSUER_PREFIXES = (
    "AIza", "AKIA", "ASIA", "EAAC", "SG", "dckr_pat_", "eyJ", "ghp_", "gho_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "hf_", "npm_", "pk_live_",
    "pypi-", "rk_live_", "shpat_", "sk-", "sk_live_", "sk_test_", "xoxa-", "xoxb-", "xoxp-", "ya29",
)
#: Gazetteer: letters of an account number (IBAN) by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
#: Gazetteer: digit groups of telephone and identity numbers as they are written.
NUMBER_FORMATS = frozenset(("3-3-4", "3-2-4", "2-2-2-2-2", "4-4-4-4", "3-4-4", "2-4-4", "5-6", "3-3-3"))
LABELERS = ("shape", "gazetteer", "context", "characters", "checksum")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9][A-Za-z0-9_-]{14,}[A-Za-z0-9](?![A-Za-z0-9_])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9() .-]{6,22}[0-9](?![0-9A-Za-z])")
_SHAPE = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{16,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NAMED = re.compile(r"(?<![a-z])(?:%s)(?![a-z])" % "|".join(CONTEXT))
_DIGITS = re.compile("[0-9]+")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start; offsets are code points, ends exclusive."""
    found = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _listed(kind: str, span: str) -> bool:
    """Whether the gazetteers know the span's issuer, country format or grouping."""
    if kind == "secret":
        return span.startswith(ISSUER_PREFIXES) or IBAN_LENGTHS.get(span[:2]) == len(span)
    return "-".join(str(len(g)) for g in _DIGITS.findall(span)) in NUMBER_FORMATS


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 abstains."""
    span, before = text[start:end], text[max(0, start - 24) : start]
    digits = [c for c in span if "0" <= c <= "9"]
    share = len(digits) / len(span)
    shape = (_SHAPE if kind == "secret" else _LOCAL_PHONE).fullmatch(span) is not None
    named, assigned = _NAMED.search(before.lower()), _ASSIGNED.search(before)
    if kind == "secret":
        mixed = 0.1 <= share <= 0.9 and "-" not in span and _entropy(span) >= 3.0
        checksum = 0
    else:
        mixed = 0.7 <= share
        checksum = (1 if luhn("".join(digits)) else -1) if len(digits) >= 13 else 0
    return (
        1 if shape else -1,
        1 if _listed(kind, span) else 0,
        1 if named or assigned else 0,
        1 if mixed else -1,
        checksum,
    )


def _span_features(text: str, start: int, end: int) -> str:
    """Four digits 0 to 3: length, share of digits, letter case and entropy of the span."""
    span = text[start:end]
    share = sum("0" <= c <= "9" for c in span) / len(span)
    case = (span != span.upper()) + 2 * (span != span.lower())
    return f"{min(3, len(span) // 12)}{min(3, int(share * 4))}{case}{min(3, int(_entropy(span)))}"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Proposed spans outside the base spans, with the pattern of votes and features that decides on them."""
    if not _DIGIT.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for kind, pattern in (("secret", _TOKEN), ("number", _NUMBER)):
        for m in pattern.finditer(text):
            start, end = m.span()
            if not _DIGIT.search(m[0]) or any(s < end and start < e for s, e in taken):
                continue
            if kind == "secret":
                taken.append((start, end))
            votes = "".join("-0+"[v + 1] for v in _votes(kind, text, start, end))
            out.append((kind, start, end, f"{kind}|{votes}|{_span_features(text, start, end)}"))
    return out


def fit_votes(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """EM over the vote patterns of each kind: P(real) per pattern, and by kind P(vote | truth) as (labeler, truth, vote)."""
    real, rates = {}, {}
    for kind in sorted({p.split("|")[0] for p in counts}):
        own = {p: n for p, n in counts.items() if p.split("|")[0] == kind}
        found, rates[kind] = _fit_kind(own, rounds)
        real.update(found)
    return real, rates


def _fit_kind(counts: dict[str, int], rounds: int) -> tuple[dict[str, float], np.ndarray]:
    patterns = sorted(counts)
    votes = np.array([["-0+".index(c) for c in p.split("|")[1]] for p in patterns]).reshape(-1, len(LABELERS))
    n = np.array([counts[p] for p in patterns], dtype=float)
    real = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(axis=1)))
    rates = np.full((len(LABELERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack((n * (1 - real), n * real))
        for j in range(len(LABELERS)):
            for v in range(3):
                rates[j, :, v] = weight[:, votes[:, j] == v].sum(axis=1) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        log = np.log(prior)[:, None] + sum(np.log(rates[j][:, votes[:, j]]) for j in range(len(LABELERS)))
        real = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return dict(zip(patterns, real, strict=True)), rates


def _features(pattern: str) -> np.ndarray:
    """A block of intercept, votes for and against, and span features for each kind; the other kind's block is zero."""
    kind, votes, features = pattern.split("|")
    block = [1.0, *(float("-0+".index(v) == k) for v in votes for k in (0, 2)), *(float(int(f) == k) for f in features for k in (1, 2, 3))]
    return np.concatenate([np.array(block) * (kind == k) for k in EXTRA_KINDS])


def train_classifier(counts: dict[str, int], real: dict[str, float], steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression (Newton steps) of the estimated labels on the span features."""
    x = np.array([_features(p) for p in sorted(counts)])
    n = np.array([counts[p] for p in sorted(counts)], dtype=float)
    n = n / n.sum() * 1000
    y = np.array([real[p] for p in sorted(counts)])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + ridge * 1e-2 * w
        hessian = (x.T * (n * p * (1 - p))) @ x + ridge * 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


def accepted_patterns(counts: dict[str, int], threshold: float = 0.5) -> frozenset[str]:
    if not counts:
        return frozenset()
    w = train_classifier(counts, fit_votes(counts)[0])
    return frozenset(p for p in counts if 1 / (1 + math.exp(-max(-30.0, min(30.0, float(_features(p) @ w))))) >= threshold)


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, extra array<struct<kind:string,start:int,end:int,pattern:string>>"


def _find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                written = _written(base)
                extra = [dict(zip(("kind", "start", "end", "pattern"), c, strict=True)) for c in candidates(text, base)]
                digest = hashlib.sha256(written.encode()).hexdigest()
                rows.append((doc_id, *(n[k] for k in BASE_KINDS), digest, written, extra))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "base", "extra"])

    rows = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    return id_long(rows.mapInPandas(run, _FOUND))


def _pattern_counts(found: DataFrame) -> dict[str, int]:
    """Spans by pattern; at most 2 * 3**5 * 4**4 entries, however many documents."""
    rows = found.select(F.explode("extra.pattern").alias("p")).groupBy("p").count().collect()
    return {r["p"]: r["count"] for r in rows}


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    spans lists kind:start:end of the base spans by kind and start, then of the
    accepted spans (secret, number).  Null and empty texts have no spans;
    repeated and null ids pass through; an empty table gives no rows.
    """
    found = materialise(_find(docs, id_col, text_col), "spans", TEXT_BATCH)
    accepted = accepted_patterns(_pattern_counts(found))
    kept = F.filter("extra", lambda x: x["pattern"].isin(*sorted(accepted)) if accepted else F.lit(False))
    extra = F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), extra)
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", spans.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; overlapping spans make one.

    Votes are counted over all documents first; a second scan decides and
    rewrites, so texts are never shuffled.  Null texts stay null; all rows and
    all other columns stay as they are, bit for bit.
    """
    found = materialise(_find(docs, id_col, text_col).select("extra"), "spans", TEXT_BATCH)
    accepted = accepted_patterns(_pattern_counts(found))
    discard(found)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            field = batch.schema.field(at)
            texts = [None if t is None else _redacted(t, accepted) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, field, pa.array(texts, type=field.type))

    return docs.mapInArrow(run, schema)


def _redacted(text: str, accepted: frozenset[str]) -> str:
    base = base_spans(text)
    spans = sorted([(s, e, k) for k, s, e in base] + [(s, e, k) for k, s, e, p in candidates(text, base) if p in accepted])
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    out.append(text[done:])
    return "".join(out)
