import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import decontaminate, pii, quality, tool_calls
from auralake.llm.line_dedup import dedup_lines, repeated_runs
from auralake.llm.suffix_dedup import repeated_passages

DATA = "/root/testdata/sf0.001"
RNG = random.Random(11)


def words(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randrange(900)}" for _ in range(n)]


# ---- op1 ---------------------------------------------------------------------------------------


def covered(rows, n=50):
    """Words of each text that lie in an n-word run occurring at least twice anywhere."""
    where = defaultdict(list)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            where[" ".join(w[k : k + n])].append((i, k))
    out = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                out[i].update(range(k, k + n))
    return {i: s for i, s in out.items() if s}


def test_repeated_passages_equal_brute_force(spark):
    rows = []
    for i in range(60):
        w = words(RNG.randrange(20, 400), i)
        if i % 3 == 0:
            at = RNG.randrange(len(w))
            w[at:at] = words(50 + i, 1000 + i % 6)
        if i % 10 == 1:
            w = words(49, 5000) + w
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[4][1])]
    found = defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    expected = covered(rows)
    assert set(found) == set(expected)
    assert all(expected[i] <= found[i] for i in expected)
    assert sum(map(len, found.values())) <= sum(map(len, expected.values())) * 1.02


def test_repeated_passages_of_scattered_neighbours(spark):
    """A common line of 46 words in many texts; pairs among them share 4 to 10 words before it as well."""
    rows = []
    for g in range(12):
        line = words(46, 700 + g)
        for k in range(60):
            before = words(10, 7000 + g * 10 + k // 20) if k % 20 < 2 else words(10, 8000 + g * 100 + k)
            cut = words(6 - g % 7, 8500 + g * 100 + k) if k % 20 < 2 and g % 7 < 6 else []
            rows.append((g * 100 + k, " ".join(words(30, 20_000 + g * 100 + k) + cut + before[len(cut) :] + line + words(40, 30_000 + g * 100 + k))))
    found = defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    expected = covered(rows)
    assert len(expected) == 72 and set(found) == set(expected)
    assert all(expected[i] <= found[i] for i in expected)


def test_removable_passages_keep_every_first_occurrence(spark):
    """P and Q meet in document 5; Q is first in 1, P is first in 5."""
    p, q = words(120, 71), words(120, 72)
    rows = [(1, words(30, 73) + q), (5, words(30, 74) + p + q), (9, p + words(30, 75)), (9, words(200, 76))]
    found = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["removable"]) for r in found}
    assert got == {(1, 30, 150, False), (5, 30, 150, False), (5, 150, 270, True), (9, 0, 120, True)}


def test_other_texts_of_a_repeated_id_are_searched(spark):
    a, b, c = words(80, 81), words(70, 82), words(60, 83)
    rows = [(1, a), (2, a), (2, words(20, 84) + b), (3, b + words(20, 85)), (4, c), (4, c)]
    found = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["removable"]) for r in found}
    assert got == {(1, 0, 80, False), (2, 0, 80, True), (2, 20, 90, False), (3, 0, 70, True)}


def test_repeated_passages_awkward(awkward, empty):
    found = {(r["doc_id"], r["removable"]): r for r in repeated_passages(awkward).collect()}
    assert {(1, False), (2, True), (7, False), (7, True)} == set(found)
    assert (found[2, True]["start_word"], found[2, True]["end_word"]) == (0, 60)
    assert repeated_passages(empty).count() == 0


# ---- op2 ---------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    alphabet = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "2", "0", "255", "4111 1111 1111 1111", "b.c", "x@y.z", "\n", "%", "_", "+1 555"]
    for seed in range(4000):
        r = random.Random(seed)
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_pii_spans(spark, awkward, empty):
    rows = {r["doc_id"]: r for r in pii.find_spans(awkward).collect()}
    assert rows[8]["n_phone"] == rows[8]["n_email"] == 1 and rows[8]["spans"].startswith("email:")
    assert rows[3]["spans"] == "" and rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_spans(empty).count() == 0 and pii.redact(empty).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(awkward).collect()}
    assert red[3] is None and red[8].endswith("[PHONE] [EMAIL]") and red[6] == "two words"


ALNUM = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def proposable(kind, text, s, e):
    """Whether [s, e) is a loose candidate, told character by character."""
    wall = ALNUM | {"_"} if kind == "secret" else ALNUM
    if (s and text[s - 1] in wall) or (e < len(text) and text[e] in wall):
        return False
    if kind == "secret":
        span = text[s:e]
        return len(span) >= 16 and span[0] in ALNUM and span[-1] in ALNUM and set(span) <= ALNUM | {"_", "-"}
    body = text[s + (text[s] == "(") : e]
    return 8 <= len(body) <= 24 and body[0] in "0123456789" and body[-1] in "0123456789" and set(body) <= set("0123456789() .-")


def plain_candidates(text, base):
    """Longest candidates from left to right, those with a digit and clear of base spans and of secrets."""
    taken, out = [(s, e) for _, s, e in base], []
    for kind in ("secret", "number"):
        at = 0
        while at < len(text):
            end = next((e for e in range(len(text), at, -1) if proposable(kind, text, at, e)), None)
            if end and any(c in "0123456789" for c in text[at:end]) and not any(s < end and at < e for s, e in taken):
                out.append((kind, at, end))
                if kind == "secret":
                    taken.append((at, end))
            at = end or at + 1
    return out


def test_candidates_equal_a_plain_scan():
    alphabet = ["a", "é", "_", "-", " ", "(", ")", ".", "7", "12", "555", "abcdefgh", "A1b2C3d4", "token=", "+1 ", "x@y.z", "4111 1111 1111 1111", "\n", "\u0663"]
    for seed in range(4000):
        r = random.Random(seed)
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 20)))
        base = plain_spans(text)
        assert [c[:3] for c in pii.candidates(text, base)] == plain_candidates(text, base), text


def test_weak_supervision_finds_secrets_and_leaves_numbers(spark):
    rows = [(i, f"some words token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" and order {10**15 + i * 7} more") for i in range(80)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("secret:" in r["spans"] for r in found)
    assert sum(r["spans"].count("secret:") for r in found) == 80
    assert not any("number:" in r["spans"] for r in found)  # order numbers without a known form


def test_spans_equal_a_plain_pass(spark):
    """Counts over all texts, then each text's spans by the accepted patterns, in plain Python."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts = Counter(c[3] for t in texts.values() for c in pii.candidates(t, plain_spans(t)))
    accepted = pii.accepted_patterns(dict(counts))
    expected = {}
    for i, t in texts.items():
        base = plain_spans(t)
        spans = base + [c[:3] for c in pii.candidates(t, base) if c[3] in accepted]
        expected[i] = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert {r["doc_id"]: r["spans"] for r in pii.find_spans(docs).collect()} == expected


def test_gazetteers():
    assert pii._listed("secret", "ghp_" + "a1" * 18) and pii._listed("secret", "DE89370400440532013000") and not pii._listed("secret", "DE8937040044053201300")
    assert pii._listed("number", "(555) 555-1234") and not pii._listed("number", "1000000000000007")


def test_em_recovers_reliabilities():
    counts = {"secret|+++++|1232": 400, "secret|-0---|1232": 500, "secret|+0-+-|1232": 30, "secret|--0--|1232": 60, "number|-0-+-|0301": 900, "number|+++++|0301": 50}
    real, rates = pii.fit_votes(counts)
    assert real["secret|+++++|1232"] > 0.99 and real["secret|-0---|1232"] < 0.01 and real["number|+++++|0301"] > 0.99
    assert rates["secret"][0, 1, 2] > 0.8 and all(abs(r.sum(axis=2) - 1).max() < 1e-9 for r in rates.values())
    assert rates["number"][3, 0, 2] > 0.9 > rates["secret"][3, 0, 2]  # the characters labeler is worse on numbers


def test_features_decide_where_votes_agree():
    """Spans with the same votes are told apart by what they look like."""
    counts = {"secret|+++++|3132": 300, "secret|-0---|0210": 300, "secret|-0-+-|3132": 20, "secret|-0-+-|0210": 20}
    accepted = pii.accepted_patterns(counts)
    assert "secret|+++++|3132" in accepted and "secret|-0---|0210" not in accepted and "secret|-0-+-|0210" not in accepted


# ---- op3 ---------------------------------------------------------------------------------------


def test_quality_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).join(labels, "doc_id").collect()
    tested = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in tested) / len(tested) > 0.95
    good = [r["score"] for r in tested if r["quality"] == 1]
    bad = [r["score"] for r in tested if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_scores_equal_a_plain_discriminant(spark):
    """Shrunk Gaussians by np.cov, inverses and determinants instead of sums per task and Cholesky factors."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in texts}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    train, y = np.array([x[i] for i in known]), np.array(list(known.values()))
    centre, scale = train.mean(axis=0), np.maximum(train.std(axis=0), 1e-3)
    z = (train - centre) / scale
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covs[k] for k in (0, 1))
    dense = []
    for k in (0, 1):
        c = 0.8 * covs[k] + 0.2 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        d = (np.array([x[i] for i in texts]) - centre) / scale - z[y == k].mean(axis=0)
        dense.append(np.log(((y == k).sum() + 1) / (len(y) + 2)) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)))
    expected = dict(zip(texts, 1 / (1 + np.exp(-(dense[1] - dense[0]) / np.sqrt(train.shape[1]))), strict=True))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got)


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, "z"), (6, 0, "z"), (2, None, "z"), (None, 1, "z")], "doc_id long, quality int, text string")
    assert quality.score_documents(awkward, labels).filter("score BETWEEN 0 AND 1").count() == awkward.count()
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.score_documents(awkward, labels.limit(0)).filter("score = 0.5").count() == awkward.count()


# ---- op4 ---------------------------------------------------------------------------------------


def plain_runs(rows, least):
    """The rule word for word: (doc, start, end, removed) of the runs in chains of repeated units."""
    units, places = {}, defaultdict(list)
    for i, t in rows:
        parts, at = [], 0
        while at < len(t):
            end = at
            while end < len(t) and not (t[end] == "\n" or (t[end] in ".!?,;:" and t[end + 1 : end + 2] in tuple(" \t\n\v\f\r"))):
                end += 1
            end = min(len(t), end + (2 if t[end : end + 1] not in ("", "\n") else 1))
            if t[at:end].split():
                parts.append((at, end, " ".join(t[at:end].lower().split())))
                places[parts[-1][2]].append((i, at))
            at = end
        units[i] = parts
    out = set()
    for i, parts in units.items():
        k = 0
        while k < len(parts):
            m = k
            while m < len(parts) and len(places[parts[m][2]]) > 1:
                m += 1
            if sum(len(p[2].split()) for p in parts[k:m]) >= least:
                later = [min(places[p[2]]) != (i, p[0]) for p in parts[k:m]]
                for j in range(k, m):
                    if j > k and later[j - k] == later[j - k - 1]:
                        last = (last[0], last[1], parts[j][1], last[3])
                    else:
                        if j > k:
                            out.add(last)
                        last = (i, parts[j][0], parts[j][1], later[j - k])
                out.add(last)
            k = max(m, k + 1)
    return out


def test_repeated_runs_equal_the_plain_rule(spark):
    r, pool = random.Random(4), [" ".join(words(2 + k % 9, k)) + ".,;!?:"[k % 6] for k in range(60)]
    rows = []
    for i in range(120):
        parts = [r.choice(pool) if r.random() < 0.7 else " ".join(words(5, 900 + 40 * i + j)) + "." for j in range(r.randrange(1, 40))]
        at = r.randrange(0, 50)
        rows.append((i, "".join(p + r.choice((" ", "\n", "  ", " \n")) for p in parts[:at] + pool[at : at + 8] + parts[at:])))
    found = repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words=30).collect()
    expected = plain_runs(rows, 30)
    assert {(f["doc_id"], f["start"], f["end"], f["removed"]) for f in found} == expected and len(found) == len(expected) > 200


def test_line_dedup(spark, awkward, empty):
    line = " ".join(words(30, 3))
    docs = spark.createDataFrame([(2, f"a b\n{line}\nown text of two is here"), (1, f"{line.upper()} \nx"), (3, f"{line}\n{line}\nshort line"), (4, None)], "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["end"], r["removed"], r["kept_doc_id"], r["kept_start"]) for r in repeated_runs(docs).collect()}
    n = len(line) + 1
    assert found == {(1, 0, n + 1, False, 1, 0), (2, 4, 4 + n, True, 1, 0), (3, 0, 2 * n, True, 1, 0)}
    clean = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert clean == {1: f"{line.upper()} \nx", 2: "a b\nown text of two is here", 3: "short line", 4: None}
    assert {(r["doc_id"], r["removed"]) for r in repeated_runs(awkward).collect()} == {(1, False), (2, True)}
    assert repeated_runs(empty).count() == 0 and dedup_lines(awkward).count() == awkward.count()


def test_line_dedup_of_a_repeated_id(spark):
    """Of the texts of one id each loses its own repeated runs only; equal rows stay whole."""
    line, other = " ".join(words(35, 5)), " ".join(words(40, 6))
    rows = [(1, line), (6, line + "\nthe end"), (6, other + "\nits end"), (7, other), (7, other)]
    clean = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect()) == [(1, line), (6, other + "\nits end"), (6, "the end"), (7, ""), (7, "")]


# ---- op8 ---------------------------------------------------------------------------------------


def bench(spark, n=70):
    items = [(i, " ".join(words(15 + i % 60, 9000 + i)) + ".") for i in range(n)] + [(900, None), (901, ""), (None, "x y z")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_leaks_are_found_and_clean_texts_left(spark, awkward, empty):
    items, benchmark = bench(spark)
    docs, expected = [], set()
    for i in range(150):
        w = words(300, i)
        if i % 2:
            item = i % 70
            at = RNG.randrange(300)
            w[at:at] = items[item][1].upper().split() if i % 3 else items[item][1].split()
            expected.add((i, item))
        docs.append((i, " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert found == expected
    assert decontaminate.find_leaks(awkward, benchmark).count() == 0 and decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(frame, benchmark.limit(0)).count() == 0


def test_pruned_search_equals_full_scores(spark, monkeypatch):
    _, benchmark = bench(spark)
    rows = decontaminate.index_items(benchmark, "item_id", "text", 0.34).collect()
    index = decontaminate.ItemIndex(sorted(rows, key=lambda r: r["item_id"]), 64)
    for seed in range(30):
        text = " ".join(words(40, seed) + words(15 + seed % 60, 9000 + seed) + words(200, 77 + seed))
        h = decontaminate.term_hashes(text)
        got = {i: s for i, s, _ in index.search(h, 0.3)}
        full = {}
        for first in range(0, len(h), 32):
            own = set(h[first : first + 64].tolist())
            for i, r in enumerate(sorted(rows, key=lambda r: r["item_id"])):
                s = sum(w for t, w in zip(r["terms"], r["weights"], strict=True) if t % 2**64 in own)
                if s >= 0.3:
                    full[i] = max(full.get(i, 0), s)
        assert got.keys() == full.keys() and all(abs(got[i] - full[i]) < 1e-9 for i in got)


def test_wand_equals_full_scores_for_any_threshold():
    """The pivot loop against plain sums, on made-up postings with common and rare terms."""
    rng = np.random.default_rng(8)
    terms = np.sort(rng.integers(1, 2**62, 300))
    items = []
    for i in range(90):
        own = np.sort(rng.choice(terms, int(rng.integers(3, 40)), replace=False, p=(w := 1 / np.arange(1, 301)) / w.sum()))
        weight = rng.random(len(own))
        items.append({"item_id": i, "length": len(own), "terms": own.tolist(), "weights": (weight / weight.sum()).tolist(), "question": [], "answer": []})
    index = decontaminate.ItemIndex(items, 64)
    for threshold in (0.1, 0.3, 0.5, 0.9):
        for _ in range(40):
            asked = np.unique(rng.integers(0, len(index.terms), int(rng.integers(1, 60)))).tolist()
            held = {int(index.terms[t]) for t in asked}
            full = {i["item_id"]: sum(w for t, w in zip(i["terms"], i["weights"], strict=True) if t in held) for i in items}
            got = dict(index._wand(asked, threshold))
            assert got.keys() == {i for i, x in full.items() if x >= threshold} and all(abs(got[i] - full[i]) < 1e-9 for i in got)


def test_a_long_item_does_not_lengthen_the_passages_of_short_ones(spark):
    items = [(1, " ".join(words(20, 301))), (2, " ".join(words(900, 302)))]
    scattered = []
    for k, w in enumerate(words(20, 301)):  # the words of item 1, far apart
        scattered += [w, *words(30, 400 + k)]
    docs = [(1, " ".join(words(100, 303) + items[0][1].split() + words(50, 304))), (2, " ".join(scattered)), (3, " ".join(words(40, 305) + items[1][1].split()))]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), overlap=0.0)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(1, 1), (3, 2)]


def test_rounds_give_the_same(spark, monkeypatch):
    items, benchmark = bench(spark)
    frame = spark.createDataFrame([(i, " ".join(words(80, i)) + " " + items[i][1]) for i in range(40)], "doc_id long, text string")
    one = sorted(tuple(r)[:2] for r in decontaminate.find_leaks(frame, benchmark).collect())
    monkeypatch.setattr(decontaminate, "ROUND_ITEMS", 30)
    assert sorted(tuple(r)[:2] for r in decontaminate.find_leaks(frame, benchmark).collect()) == one


def test_items_with_a_repeated_id(spark):
    light, heavy, plain = words(20, 31), words(60, 32), words(64, 33)
    items = [(1, " ".join(light)), (1, " ".join(heavy))] + [(2, " ".join(plain))] * 6 + [(3, " ".join(words(30, 34)))]
    inserted = {10: (light, 40), 11: (heavy, 0), 12: (plain, 16), 13: (plain, 32), 14: (light + words(100, 35) + heavy, 5), 15: ([], 0)}
    docs = []
    for i, (text, at) in inserted.items():
        w = words(200, 40 + i)
        w[at:at] = text
        docs.append((i, " ".join(w)))
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(10, 1), (11, 1), (12, 2), (13, 2), (14, 1)]


def test_a_verified_passage_counts_beside_a_better_scored_one(spark):
    item = words(60, 51)
    shuffled = random.Random(5).sample(item, len(item))
    docs = [
        (1, shuffled + words(36 + 160, 52) + item + words(100, 53)),  # the item cut by the passage grid
        (2, shuffled + words(36 + 160, 54)),
        (3, words(64, 55) + item[:40] + words(400, 56) + item),
        (4, words(17, 57) + item + words(300, 58) + item),
    ]
    found = decontaminate.find_leaks(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"),
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (3, 1), (4, 1)]
    assert all(r["score"] >= 0.5 and r["question_overlap"] >= 0.5 and r["answer_overlap"] >= 0.5 for r in found)
    assert {r["doc_id"]: r["first_word"] for r in found}[1] >= 224


# ---- op9 ---------------------------------------------------------------------------------------


def test_tool_calls(spark):
    schema = "conv_id long, call_id string, turn long, tool string, arguments string, parent_id string"
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "lookup", '{"query": "x\\n", "limit": 5}', None),
            (1, "b", 2, "lookup", '{"limit": "5", "query": "y"}', "a"),
            (1, "c", 4, "measure", '{"exact": 1}', "b"),
            (1, "c", 6, "note", "{}", "b"),
            (2, "p", 0, "nope", "not json", "q"),
            (2, "q", 1, "note", None, "p"),
            (3, "r", 9, "note", '{"text": "t", "tags": []}', "missing"),
            (None, "z", 0, "note", "{}", None),
        ],
        schema,
    )
    results = spark.createDataFrame([(1, "a", 1, 'said "hi"'), (1, "a", 5, "later"), (3, "r", 2, None), (4, "lost", 1, "x")], "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(calls, results, tool_calls.SCHEMAS).collect()}
    assert len(got) == 7
    a, b, c = got[1, "a"], got[1, "b"], got[1, "c"]
    assert (a["status"], a["level"], a["valid"], a["errors"]) == ("linked", 0, True, "")
    assert a["record"] == '{"arguments":{"limit":5,"query":"x\\n"},"call_id":"a","result":"said \\"hi\\"","tool":"lookup"}'
    assert (b["level"], b["errors"], b["status"]) == (1, "limit: not integer", "pending")
    assert (c["level"], c["errors"]) == (2, "exact: not boolean; length: missing")
    assert got[2, "p"]["level"] is None and got[2, "p"]["errors"] == "arguments: not JSON; tool: unknown"
    assert got[3, "r"]["status"] == "early" and got[3, "r"]["valid"] and json.loads(got[3, "r"]["record"])["result"] is None
    assert got[4, "lost"]["status"] == "orphan" and json.loads(got[4, "lost"]["record"])["tool"] is None
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), tool_calls.SCHEMAS).count() == 0


def test_long_chains_and_cycles_of_calls(spark):
    """A chain of 2,500 calls takes a dozen rounds; calls in a cycle and below one have no level."""
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(2500)] + [(2, "a", "c"), (2, "b", "a"), (2, "c", "b"), (2, "below", "a"), (3, "own", "own"), (3, "free", "x")]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, parent_id string")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.topological_levels(calls).collect()}
    assert len(got) == len(rows) and all(got[1, f"c{i}"] == i for i in range(2500))
    assert {got[2, c] for c in ("a", "b", "c", "below")} == {None} and got[3, "own"] is None and got[3, "free"] == 0


def test_nested_schemas(spark):
    schema = {"t": {"mode": {"type": "string", "required": True, "enum": ["fast", "slow"]}, "ids": {"type": "array", "items": "integer"}, "at": {"type": "object", "required": False, "properties": {"x": ("number", True), "in": {"type": "object", "properties": {"y": ("boolean", True)}}}}}}
    texts = ['{"mode": "fast", "ids": [1, 2], "at": {"x": 1.5, "in": {"y": true}}}', '{"mode": "best", "ids": ["a"], "at": {"in": {}}}', '{"at": 3}', '{"mode": "slow", "ids": [], "more": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", tool_calls.validation_errors(F.try_parse_json("t"), F.lit("t"), schema).alias("e")).collect()}
    assert got == {0: [], 1: ["at.in.y: missing", "at.x: missing", "ids: items not integer", "mode: not allowed"], 2: ["at: not object", "mode: missing"], 3: []}


def test_tool_calls_use_hash_joins_and_no_python(spark):
    talk = spark.read.parquet(f"{DATA}/conversations.parquet")
    linked = tool_calls.link_tool_calls(tool_calls.derive_calls(talk), tool_calls.derive_results(talk), tool_calls.SCHEMAS)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "FullOuter" in plan and "Python" not in plan and "Pandas" not in plan


def test_tool_calls_awkward(spark):
    """Nulls in any column, very long texts, repeated rows, extra columns with clashing names."""
    long = "x" * 200_000
    schema = "conv_id long, turn int, role string, text string, call_id string, level string, up string"
    rows = [(1, 0, "user", "hi", "a", "b", "c"), (1, 1, "assistant", long, "a", "b", "c"), (1, 2, "user", long, None, None, None), (1, 1, "assistant", long, "a", "b", "c"), (1, None, "assistant", "t", "a", "b", "c"),
            (None, 1, "assistant", "t", "a", "b", "c"), (2, 1, "assistant", None, "a", "b", "c"), (2, 2, "user", None, "a", "b", "c"), (2, 3, None, "t", "a", "b", "c"), (3, 4, "user", "", "a", "b", "c")]
    talk = spark.createDataFrame(rows, schema)
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(tool_calls.derive_calls(talk), tool_calls.derive_results(talk), tool_calls.SCHEMAS).collect()}
    assert {k: r["status"] for k, r in got.items()} == {(1, "call_-1"): "orphan", (1, "call_1"): "linked", (2, "call_1"): "linked", (3, "call_3"): "orphan"}
    assert json.loads(got[1, "call_1"]["record"])["result"] == long and json.loads(got[2, "call_1"]["record"])["result"] is None
    empty = talk.limit(0)
    assert tool_calls.link_tool_calls(tool_calls.derive_calls(empty), tool_calls.derive_results(empty), tool_calls.SCHEMAS).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns, name
        assert after.count() <= kept.count()
        from auralake.llm.storage import materialise

        kept = materialise(after, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert pii.find_spans(kept).agg({"n_email": "sum", "n_phone": "sum", "n_card": "sum"}).first()[0] == 0
    assert decontaminate.find_leaks(kept, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
