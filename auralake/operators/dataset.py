"""Dataset curation: rejects, label conflicts, duplicates, selection, splits, ids, statistics, augmentation plans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions.rules import GRADES, SEVERITIES, rule_sql, rule_table, with_rule
from auralake.operators.ordering import join_spread, numbered, settled, small
from auralake.plans.registry import Views, query

#: Text before ':' or ' (' in a reason.  Fixed wording of the reject reasons.
EMPTY, SHORT, SILENT = "empty file", "too short", "silent"


def rejection_reason(duration: str, peak: str, size: str, min_duration: float = 0.3, silence_peak: float = 0.001) -> Column:
    """First reason against a file, or null: empty, too short, silent; a null measure counts as empty."""
    return (
        F.when(F.col(size).isNull() | (F.col(size) == 0) | F.col(duration).isNull(), EMPTY)
        .when(F.col(duration) < min_duration, F.format_string(f"{SHORT} (%.2f s)", F.col(duration)))
        .when(F.col(peak) < silence_peak, F.format_string(f"{SILENT} (peak %.4f)", F.col(peak)))
    )


def admissible(extension: Column, size: str, rate: str, channels: str, duration: str, usable: Column | None = None) -> Column:
    """Reason why an upload is refused, or null."""
    checks = (
        F.when(~extension.isin("wav", "flac", "mp3", "ogg", "m4a"), "format")
        .when(F.col(size) > 50 * 1024 * 1024, "size")
        .when(F.col(size) == 0, "empty")
        .when(F.col(rate) < 8000, "sample rate")
        .when(F.col(channels) > 8, "channels")
        .when(F.col(duration) > 600, "duration")
    )
    return checks if usable is None else checks.when(~usable, "unusable")


def admissible_window(size: str, duration: str) -> Column:
    """Reason why a live window is refused, or null: no or too many bytes (2 MB), or not 0.3 to 5 seconds."""
    return (
        F.when(F.col(size).isNull() | (F.col(size) == 0) | (F.col(size) > 2 * 1024 * 1024), "size")
        .when(F.col(duration).isNull(), "not decoded")
        .when(~F.col(duration).between(0.3, 5.0), "length")
    )


#: Windows of one payload that are read unless told otherwise.
PAYLOAD_WINDOWS = 2000
_PAYLOAD = "labels array<string>, clip array<double>, windows array<struct<start: double, end: double, probs: array<double>>>, version string, error string, elapsed_ms double"


def parse_scores(payload: str, most: int | None = PAYLOAD_WINDOWS) -> Column:
    """struct<scores, windows, error, version, elapsed_ms> of a JSON payload {labels, clip, windows: [{start, end, probs}]}.

    Scores are clipped to [0, 1] and rounded to five digits, halves to even.
    error is '' for a good payload, and else says what is wrong; then scores and
    windows are null.  Of a payload the first `most` windows are read (two hours
    at three seconds are 2,400; None: all of them).  Fewer than two classes, labels that repeat or have more
    than 40 letters, and scores that are no probabilities (1e-6 beyond [0, 1], a
    sum 0.02 from 1), in the clip or in any window, spoil the whole payload.
    """
    p = F.from_json(F.col(payload), _PAYLOAD)
    n = p["labels"]
    windows = F.coalesce(p["windows"], F.array().cast("array<struct<start: double, end: double, probs: array<double>>>"))
    windows = windows if most is None else F.slice(windows, 1, most)
    bad_number = lambda x: x.isNull() | F.isnan(x) | (x < -1e-6) | (x > 1 + 1e-6)
    total = lambda m: F.aggregate(m, F.lit(0.0), lambda a, b: a + b)
    bad = lambda m: F.coalesce(F.exists(m, bad_number) | (F.abs(total(m) - 1) > 0.02), F.lit(True))
    error = (
        F.when(F.coalesce(F.col(payload), F.lit("")) == "", "nothing was sent")
        .when(p.isNull(), "not a score list")
        .when(F.coalesce(p["error"], F.lit("")) != "", F.left(p["error"], F.lit(250)))
        .when(n.isNull() | p["clip"].isNull(), "not a score list")
        .when((F.size(n) != F.size(p["clip"])) | (F.size(n) < 2), "labels and scores differ in number")
        .when(F.exists(n, lambda x: x.isNull() | (F.length(x) > 40)) | (F.size(F.array_distinct(n)) != F.size(n)), "bad labels")
        .when(bad(p["clip"]) | F.exists(windows, lambda w: bad(w["probs"])), "not probabilities")
        .when(F.exists(windows, lambda w: w["start"].isNull() | w["end"].isNull()), "window without a place")
        .otherwise("")
    )
    named = lambda m: F.map_from_entries(F.transform(F.slice(n, 1, F.least(F.size(n), F.size(m))), lambda c, i: F.struct(c, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(m, i))), 5))))
    placed = F.transform(windows, lambda w: F.struct(F.bround(w["start"], 3).alias("start"), F.bround(w["end"], 3).alias("end"), named(w["probs"]).alias("scores")))
    good = error == ""
    elapsed = F.when(good & (p["elapsed_ms"] >= 0), F.bround(p["elapsed_ms"], 1))
    return F.struct(
        F.when(good, named(p["clip"])).alias("scores"), F.when(good, placed).alias("windows"), error.alias("error"), F.left(F.coalesce(p["version"], F.lit("")), F.lit(60)).alias("version"), elapsed.alias("elapsed_ms")
    )


def excluded_by_words(name: str, tags: str, terms: list[str]) -> Column:
    """True where a term equals a tag or a word [a-z]+ of the lower-cased name."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+)"))
    return F.arrays_overlap(F.array_union(F.coalesce(F.col(tags), F.array().cast("array<string>")), words), F.array(*map(F.lit, terms)))


def single_class(labels: str, specific: dict[str, str], generic: dict[str, str], exclude: list[str]) -> Column:
    """The one class of a label array: null where a label is excluded, 'ambiguous' or 'unmapped' where it isn't one."""
    mapped = lambda m: F.array_distinct(F.array_compact(F.transform(F.col(labels), lambda x: F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[x])))
    s, g = mapped(specific), mapped(generic)
    found = F.when(F.size(s) > 0, s).otherwise(g)
    return F.when(F.arrays_overlap(F.col(labels), F.array(*map(F.lit, exclude))), F.lit(None).cast("string")).when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, "ambiguous").otherwise("unmapped")


def map_labels(rows: DataFrame, label_map: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the class of their source label; unmapped rows are dropped.  The map is broadcast if it is small."""
    return rows.join(small(label_map.filter("class_name IS NOT NULL")), keys, "inner")


def label_conflicts(rows: DataFrame, group: str = "group_id", label: str = "class_name") -> DataFrame:
    """(group, labels) of groups with more than one class, labels sorted."""
    per = rows.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(label)), ", ").alias("labels"), F.count_distinct(label).alias("n"))
    return per.filter("n > 1").select(group, "labels")


def drop_conflicts(rows: DataFrame, group: str = "group_id", label: str = "class_name") -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with reason): groups with more than one class are found once, and broadcast if they are few."""
    bad = small(settled(label_conflicts(rows, group, label)))
    reason = F.concat(F.lit("label conflict ("), F.replace(F.col("labels"), F.lit(", "), F.lit(" vs ")), F.lit(")"))
    return rows.join(bad, group, "left_anti"), rows.join(bad, group).withColumn("reason", reason).drop("labels")


def exact_duplicates(rows: DataFrame, digest: str, order: list[str], key: str) -> DataFrame:
    """(key, duplicate_of): later rows with the content of an earlier one.

    The first of each digest comes from partial aggregation; rows of a very
    frequent digest are joined where they are.
    """
    first = rows.groupBy(digest).agg(F.min(F.struct(*order, key)).alias("f"), F.count("*").alias("n")).filter("n > 1").select(digest, "n", F.col(f"f.{key}").alias("duplicate_of"))
    return join_spread(rows.select(key, digest), first, digest).filter(F.col(key) != F.col("duplicate_of")).select(key, "duplicate_of")


def stable_order(seed: str, *columns: str) -> Column:
    """A pseudo-random order that doesn't depend on partitions: md5 of seed and columns."""
    return F.md5(F.concat_ws(":", F.lit(seed), *columns))


def diverse_selection(rows: DataFrame, target: int, label: str = "class_name", group: str = "group_id", key: str = "path", seed: str = "42") -> DataFrame:
    """Up to `target` rows per class: one of every group before a second of any, lower priority first.

    Rows are numbered inside (class, group); only the first `target` rounds go on.
    Of these a class is cut by counts: rows per (round, priority, start of the
    group's hash) tell where the target is reached, and only the rows before that
    point and those of the boundary bucket are numbered.
    """
    inside = Window.partitionBy(label, group).orderBy("priority", stable_order(seed, key), key)
    rounds = rows.withColumn("round", F.row_number().over(inside)).filter(F.col("round") <= target)
    rounds = settled(rounds.withColumn("_bucket", F.struct("round", "priority", F.substring(stable_order(seed, group), 1, 3))))
    counts = rounds.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    within = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < target)
    last = within.groupBy(label).agg(F.max("_bucket").alias("_last"))
    cut = rounds.join(small(last), label).filter("_bucket <= _last")
    across = Window.partitionBy(label).orderBy("round", "priority", stable_order(seed, group), group)
    return cut.withColumn("place", F.row_number().over(across)).filter(F.col("place") <= target).drop("_bucket", "_last")


def first_per_class(rows: DataFrame, n: int, label: str, order: list) -> DataFrame:
    w = Window.partitionBy(label).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


SPLITS = ("train", "validation", "test")


def _run_counts(counts: list[int], weights: list[int], n: int, m: int) -> list[int]:
    """How many of m groups of size n each split gets when every group goes to the split with the smallest count / weight.

    The counts are water-filled to just below their end in one step and only the
    last few groups are dealt one by one, so m may be of any size.
    """
    live = [i for i, w in enumerate(weights) if w]
    while True:
        level = (m * n + sum(counts[i] for i in live)), sum(weights[i] for i in live)
        under = [i for i in live if counts[i] * level[1] <= level[0] * weights[i]]
        if len(under) == len(live):
            break
        live = under
    taken = [max(0, (level[0] * weights[i] - counts[i] * level[1]) // (level[1] * n) - 2) if i in live else 0 for i in range(len(weights))]
    for _ in range(m - sum(taken)):
        best = None
        for i, w in enumerate(weights):
            if w and (best is None or (counts[i] + taken[i] * n) * weights[best] < (counts[best] + taken[best] * n) * w):
                best = i
        taken[best] += 1
    return taken


def group_splits(sizes: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: str = "42") -> DataFrame:
    """(class_name, group_id, n, split): whole groups, per class from the largest, each to the split with the largest relative deficit.

    sizes: class_name, group_id, n.  Ties go to train, validation, test.  Groups
    of one size are interchangeable, so the rule runs on (class, size, number of
    groups) rows, of which a class with N clips has fewer than sqrt(2 N); the
    groups of one size are then dealt in a pseudo-random order by their number.
    """
    if abs(sum(ratios) - 1) > 1e-9 or min(ratios) < 0:
        raise ValueError("ratios must sum to 1")
    weights = [round(r * 1_000_000) for r in ratios]

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, rows = [0, 0, 0], []
        for c, n, m in sorted(zip(pdf["class_name"], pdf["n"].tolist(), pdf["m"].tolist(), strict=True), key=lambda r: -r[1]):
            taken = _run_counts(counts, weights, n, m)
            rows.append((c, n, taken[0], taken[0] + taken[1]))
            counts = [a + t * n for a, t in zip(counts, taken, strict=True)]
        return pd.DataFrame(rows, columns=["class_name", "n", "first", "second"])

    runs = sizes.groupBy("class_name", F.col("n").cast("long").alias("n")).agg(F.count("*").alias("m"))
    dealt = runs.groupBy("class_name").applyInPandas(shares, "class_name string, n long, first long, second long")
    places = numbered(sizes.select("class_name", "group_id", F.col("n").cast("long").alias("n")), ["class_name", "n"], [stable_order(seed, "group_id"), "group_id"])
    split = F.when(F.col("row_no") <= F.col("first"), SPLITS[0]).when(F.col("row_no") <= F.col("second"), SPLITS[1]).otherwise(SPLITS[2])
    return places.join(dealt, ["class_name", "n"]).select("class_name", "group_id", "n", split.alias("split"))


def leaked_groups(rows: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Groups in more than one split; must be empty after group_splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def class_codes(rows: DataFrame, order: list, label: str = "class_name", start: DataFrame | None = None) -> DataFrame:
    """audio_id like GUN-00001, numbered inside the class in the given total order, after the class's largest last_no in `start`."""
    prefix = F.upper(F.substring(F.regexp_replace(F.col(label), "[^A-Za-z]", ""), 1, 3))
    placed = numbered(rows, [label], order, "_no")
    if start is not None:
        placed = placed.join(start.groupBy(label).agg(F.max("last_no").alias("_last")), label, "left").withColumn("_no", F.col("_no") + F.coalesce("_last", F.lit(0))).drop("_last")
    text = F.col("_no").cast("string")
    return placed.withColumn("audio_id", F.concat(prefix, F.lit("-"), F.lpad(text, F.greatest(F.length(text), F.lit(5)), F.lit("0")))).drop("_no")


def split_rank(column: str = "split") -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col(column))


def extension_splits(fresh: DataFrame, known: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: str = "42") -> DataFrame:
    """(group_id, split) of the groups of new rows: known groups keep their split, the others are split per class.

    fresh: class_name, group_id; known: group_id, split.  A group that several
    classes share is decided by the class with the most new rows (then the first
    by name), and only that class's rows count as its size.
    """
    per = fresh.groupBy("class_name", "group_id").agg(F.count("*").alias("n"))
    totals = per.groupBy("class_name").agg(F.sum("n").alias("total"))
    owner = F.min_by(F.struct("class_name", "n"), F.struct(-F.col("total"), "class_name"))
    owned = per.join(totals, "class_name").groupBy("group_id").agg(owner.alias("o")).select("group_id", "o.class_name", "o.n")
    held = known.groupBy("group_id").agg(F.min("split").alias("split"))
    decided = group_splits(owned.join(held, "group_id", "left_anti"), ratios, seed).select("group_id", "split")
    return held.join(owned.select("group_id"), "group_id", "left_semi").unionByName(decided)


def new_rows(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, rejected rows with reason): paths that are known are skipped, contents that are there or came earlier in the batch are rejected."""
    fresh = new.join(existing.select("path"), "path", "left_anti")
    there = existing.groupBy("sha256").agg(F.min("path").alias("known"))
    first = fresh.groupBy("sha256").agg(F.min("path").alias("first"))
    checked = settled(fresh.join(first, "sha256").join(there, "sha256", "left"))
    copy = F.coalesce("known", F.when(F.col("path") != F.col("first"), F.col("first")))
    rejected = checked.filter(copy.isNotNull()).withColumn("reason", F.concat(F.lit("exact duplicate (of "), copy, F.lit(")")))
    return checked.filter(copy.isNull()).drop("first", "known"), rejected.drop("first", "known")


def extend_dataset(existing: DataFrame, new: DataFrame, seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(all rows with `added`, rejected rows): existing rows are unchanged, new ones get splits and ids that go on after the class's last.

    existing: path, sha256, class_name, group_id, split, audio_id.
    """
    fresh, rejected = new_rows(existing, new.drop("split", "audio_id"))
    splits = extension_splits(fresh, existing.select("group_id", "split"), seed=seed)
    last = existing.select("class_name", F.regexp_extract("audio_id", "-([0-9]+)$", 1).cast("long").alias("last_no"))
    placed = class_codes(fresh.join(splits, "group_id"), [split_rank(), "path"], start=last)
    return existing.withColumn("added", F.lit(False)).unionByName(placed.select(existing.columns).withColumn("added", F.lit(True))), rejected


def replace_rows(manifest: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The manifest with the rows of every key in `fresh` replaced."""
    return manifest.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh.select(manifest.columns))


def class_statistics(rows: DataFrame) -> DataFrame:
    """Clips per split, total, distinct recordings, seconds and clips by source (a map) per class, and a grand total (class null)."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    stats = rows.rollup("class_name").agg(*counts, F.count("*").alias("total"), F.count_distinct("origin_id").alias("recordings"), F.round(F.sum("duration_s"), 3).alias("seconds"))
    per = rows.groupBy("class_name", "source").agg(F.count("*").alias("n"))
    sources = per.groupBy("class_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))
    return stats.join(sources, "class_name", "left")


def reason_kind(reason: str) -> Column:
    return F.split_part(F.split_part(F.col(reason), F.lit(" ("), F.lit(1)), F.lit(":"), F.lit(1))


def balance_warnings(stats: DataFrame, target: int, mandatory: list[str], ratio: float = 0.8) -> DataFrame:
    """(class_name, warning): no clips of a mandatory class, clips or recordings short of the target, empty splits, and (class '') imbalance.

    stats: class_statistics, a row per class.  A target of 0 asks for nothing.
    """
    dimension = stats.sparkSession.createDataFrame([(c,) for c in mandatory], "class_name string").withColumn("needed", F.lit(True))
    every = stats.filter("class_name IS NOT NULL").join(dimension, "class_name", "full_outer").fillna(0, ["total", "recordings", *SPLITS])
    short = lambda c, what: F.when((F.lit(target) > 0) & (F.col(c) < target), F.format_string(f"{what} short by %d", F.lit(target) - F.col(c)))
    empty = F.array_join(F.array_compact(F.array(*(F.when(F.col(s) == 0, s) for s in SPLITS))), ", ")
    some = F.array_compact(F.array(short("total", "clips"), short("recordings", "recordings"), F.when(empty != "", F.concat(F.lit("no clips in "), empty))))
    w = F.when(F.col("total") > 0, some).when(F.col("needed"), F.array(F.lit("no clips")))
    per = every.select("class_name", F.explode(w).alias("warning"))
    spread = every.filter("needed").agg(F.min("total").alias("low"), F.max("total").alias("high")).filter(F.col("low") < ratio * F.col("high"))
    whole = spread.select(F.lit("").alias("class_name"), F.format_string("imbalance: %d of %d", F.col("low").cast("long"), F.col("high").cast("long")).alias("warning"))
    return per.unionByName(whole)


def segment_counts(rows: DataFrame, copy: str) -> DataFrame:
    """Originals per class and split, and copies (where the boolean column `copy` holds) beside them."""
    cells = [F.count_if((F.col("split") == s) & (F.col(copy) == c)).alias(f"{s}{'_copies' if c else ''}") for s in SPLITS for c in (False, True)]
    return rows.groupBy("class_name").agg(*cells)


def quality_summary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grade counts per class, counts per issue kind): an issue's kind is its text before ':'."""
    grades = rows.groupBy("class_name").pivot("quality_grade", ["Good", "Acceptable", "Poor", "Unusable"]).count().fillna(0)
    issue = F.explode(F.split("quality_issues", "; "))
    named = rows.filter("quality_issues <> ''").select(issue.alias("issue")).groupBy(F.split_part(F.col("issue"), F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))
    return grades, named


def scan(rows: DataFrame) -> DataFrame:
    """Files per (class, source), and files and distinct recordings per class (source null)."""
    return rows.groupingSets([["class_name", "source"], ["class_name"]], "class_name", "source").agg(F.count("*").alias("files"), F.count_distinct("origin_id").alias("recordings"))


def plan_copies(rows: DataFrame, target: int, most: int, label: str = "class_name", key: str = "path", seed: str = "42") -> DataFrame:
    """(label, key, copy_no): copies spread evenly so that each class reaches the target, at most `most` per original.

    Sizes come from an aggregate and places from `numbered`, so no class is one task.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("size")).filter(F.col("size") < target)
    placed = numbered(rows.select(label, key).join(sizes, label), [label], [stable_order(seed, key), key], "place")
    need = F.lit(target) - F.col("size")
    copies = F.least(F.floor(need / F.col("size")) + (F.col("place") <= need % F.col("size")).cast("int"), F.lit(most))
    counted = placed.withColumn("copies", copies.cast("int")).filter("copies > 0")
    return counted.select(label, key, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def noise_partners(rows: DataFrame, pool: DataFrame, number: str = "clip_no", key: str = "path", recording: str = "origin_id") -> DataFrame:
    """rows with `partner`: the pool's entry number (row number modulo pool size), or the first of the next recording if that is the row's own.

    The pool is numbered in the order of recording and key, so the entries of one
    recording follow each other; joins are by number, and only ids move.  partner
    is null where the pool has no other recording; an empty pool gives no rows.
    """
    placed = settled(numbered(pool.select(F.col(key).alias("partner"), F.col(recording).alias("_of")), [], ["_of", "partner"], "_no"))
    n = placed.count()
    if not n:
        return rows.limit(0).withColumn("partner", F.lit(None).cast("string"))
    runs = placed.groupBy("_of").agg(F.max("_no").alias("_last"))
    entries = placed.join(runs, "_of").select((F.col("_no") - 1).alias("_at"), "partner", "_of", F.pmod("_last", F.lit(n)).alias("_next"))
    first = rows.withColumn("_at", F.pmod(F.col(number), F.lit(n))).join(small(entries), "_at")
    clash = F.col("_of") == F.col(recording)
    moved = first.withColumn("_at", F.when(clash, F.col("_next")).otherwise(F.col("_at"))).drop("partner", "_of", "_next")
    second = moved.join(small(entries.select("_at", "partner", "_of")), "_at")
    return second.withColumn("partner", F.when(F.col("_of") != F.col(recording), F.col("partner"))).drop("_at", "_of")


def metadata_enriched(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows with optional per-file metadata; group = given group, else recording id, else path."""
    joined = rows.join(metadata.select("path", F.col("given_group"), F.col("recording")), "path", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return joined.withColumn("group_key", F.coalesce(blank("given_group"), blank("recording"), F.col("path")))


def rule_violations(rules: DataFrame, severities: tuple[str, ...], grades: tuple[str, ...]) -> DataFrame:
    """(category, problem): unknown severities or grades, numbers out of range, repeated categories."""
    bad = F.array_compact(
        F.array(
            F.when(~F.col("severity").isin(*severities), "severity"),
            F.when(~F.col("min_quality").isin(*grades), "grade"),
            F.when(~F.col("min_confidence").between(0, 1) | ~F.col("top_two_margin").between(0, 1), "range"),
            F.when(F.col("consecutive_detections") < 1, "repeats"),
        )
    )
    twice = rules.groupBy("category").agg(F.count("*").alias("n")).filter("n > 1").select("category", F.lit("repeated").alias("problem"))
    return rules.select("category", F.explode(bad).alias("problem")).unionByName(twice)


def label_map_violations(label_map: DataFrame, classes: DataFrame) -> DataFrame:
    """(source, label, problem) of mapped labels whose class is not in classes (name); unmapped labels are fine."""
    mapped = label_map.filter("class_name IS NOT NULL")
    return mapped.join(small(classes.select(F.col("name").alias("class_name"))), "class_name", "left_anti").select("source", "label", F.concat(F.lit("unknown class "), F.col("class_name")).alias("problem"))


def class_violations(classes: DataFrame, columns: tuple[str, ...] = ("name", "slug", "code")) -> DataFrame:
    """(field, value, n): names, slugs and codes that stand for more than one class."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns)))
    return classes.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n")).filter("n > 1")


def new_files(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows whose path is not known and whose content is not either."""
    return rows.join(known.select("path"), "path", "left_anti").join(known.select("sha256"), "sha256", "left_anti")


def missing_labels(configured: DataFrame, vocabulary: DataFrame, label: str) -> DataFrame:
    """Configured labels that the vocabulary does not have."""
    return configured.select(label).distinct().join(vocabulary.select(label), label, "left_anti")


def latest_versions(names: DataFrame, column: str = "name") -> DataFrame:
    """Highest (date, number) of name-date-number per family; other texts are left out."""
    p = lambda i: F.regexp_extract(column, r"^(.+)-([0-9]{8})-([0-9]+)$", i)
    rows = names.filter(F.col(column).rlike(r"^.+-[0-9]{8}-[0-9]+$"))
    return rows.groupBy(p(1).alias("family")).agg(F.max_by(column, F.struct(p(2), p(3).cast("long"))).alias("latest"))


# ---- queries -------------------------------------------------------------------------------------


@query(
    "p6_rejection_reasons",
    """SELECT clip_no, CASE WHEN duration_s IS NULL THEN 'empty file' WHEN duration_s < 0.3 THEN printf('too short (%.2f s)', duration_s) WHEN peak < 0.05 THEN printf('silent (peak %.4f)', peak) END AS reason FROM {clips}""",
)
def _p6(v: Views) -> DataFrame:
    return v.clips.withColumn("size", F.lit(1)).select("clip_no", rejection_reason("duration_s", "peak", "size", silence_peak=0.05).alias("reason"))


@query(
    "p7_admissibility",
    """SELECT clip_no, CASE WHEN clip_no % 9 = 0 THEN 'format' WHEN clip_no % 5 * 20000000 > 52428800 THEN 'size' WHEN clip_no % 5 = 0 THEN 'empty' WHEN clip_no % 7 * 4000 < 8000 THEN 'sample rate' WHEN clip_no % 11 > 8 THEN 'channels'
    WHEN clip_no % 700 > 600 THEN 'duration' WHEN quality_grade = 'Poor' THEN 'unusable' END AS refused,
    CASE WHEN clip_no % 5 IN (0, 3) THEN 'size' WHEN clip_no % 13 = 0 THEN 'not decoded' WHEN duration_s * 2 < 0.3 OR duration_s * 2 > 5 THEN 'length' END AS window_refused FROM {clips}""",
)
def _p7(v: Views) -> DataFrame:
    n = F.col("clip_no")
    rows = v.clips.withColumns({"size": n % 5 * 20_000_000, "rate": n % 7 * 4000, "channels": n % 11, "duration": n % 700})
    ext = F.when(n % 9 == 0, "txt").otherwise("wav")
    window = {"bytes": F.when(n % 5 == 0, 0).when(n % 5 == 3, 2_097_153).otherwise(2_097_152), "seconds": F.when(n % 13 != 0, F.col("duration_s") * 2)}
    refused = admissible(ext, "size", "rate", "channels", "duration", F.col("quality_grade") != "Poor")
    return rows.withColumns(window).select("clip_no", refused.alias("refused"), admissible_window("bytes", "seconds").alias("window_refused"))


_SHARE = "CAST(event_id % 65 AS DOUBLE) / 64"


@query(
    "p8_score_payloads",
    f"""SELECT event_id, CASE k % 12 WHEN 0 THEN 'not a score list' WHEN 1 THEN 'labels and scores differ in number' WHEN 2 THEN 'bad labels' WHEN 3 THEN 'not probabilities' WHEN 4 THEN 'not probabilities' WHEN 5 THEN 'nothing was sent'
    WHEN 6 THEN 'timeout ' || event_id WHEN 7 THEN 'not probabilities' WHEN 8 THEN 'labels and scores differ in number' WHEN 9 THEN 'not a score list' ELSE '' END AS error,
    CASE WHEN k % 12 >= 10 THEN CAST(printf('%.5f', {_SHARE}) AS DOUBLE) END AS a, CASE WHEN k % 12 = 11 THEN 1 WHEN k % 12 = 10 THEN 0 END AS n_windows, CASE WHEN k % 12 = 11 THEN CAST(printf('%.5f', 1 - {_SHARE}) AS DOUBLE) END AS b_in_window,
    CASE WHEN k % 12 = 11 THEN CAST(event_id % 9 AS DOUBLE) + 0.5 END AS elapsed_ms FROM {{keyed_events}}""",
)
def _p8(v: Views) -> DataFrame:
    p = f"CAST({_SHARE} AS STRING)"
    good = f"""'{{"labels": ["a", "b"], "clip": [' || {p} || ', ' || CAST(1 - {_SHARE} AS STRING) || ']'"""
    payload = f"""CASE k % 12 WHEN 0 THEN '{{"labels": ["a", "b"]}}' WHEN 1 THEN '{{"labels": ["a", "b"], "clip": [1]}}' WHEN 2 THEN '{{"labels": ["a", "a"], "clip": [0.5, 0.5]}}' WHEN 3 THEN '{{"labels": ["a", "b"], "clip": [1.5, -0.5]}}'
        WHEN 4 THEN '{{"labels": ["a", "b"], "clip": [0.5, 0.1]}}' WHEN 5 THEN '' WHEN 6 THEN '{{"error": "timeout ' || CAST(event_id AS STRING) || '", "labels": ["a"]}}' WHEN 7 THEN {good} || ', "windows": [{{"start": 0, "end": 1, "probs": [0.5, 0.4]}}]}}'
        WHEN 8 THEN '{{"labels": ["a"], "clip": [1]}}' WHEN 9 THEN 'no json' WHEN 10 THEN {good} || '}}'
        ELSE {good} || ', "windows": [{{"start": 0, "end": 1, "probs": [' || {p} || ', ' || CAST(1 - {_SHARE} AS STRING) || ']}}], "elapsed_ms": ' || CAST(event_id % 9 AS STRING) || '.5}}' END"""
    rows = v.keyed_events.withColumn("payload", F.expr(payload)).withColumn("x", parse_scores("payload"))
    return rows.select("event_id", "x.error", F.col("x.scores")["a"].alias("a"), F.nullif(F.size("x.windows"), F.lit(-1)).alias("n_windows"), F.get("x.windows", F.lit(0))["scores"]["b"].alias("b_in_window"), "x.elapsed_ms")


@query(
    "p9_word_exclusion",
    "SELECT p_partkey FROM part WHERE len(list_intersect(list_concat([lower(p_type)], regexp_extract_all(lower(p_name), '[a-z]+')), ['red', 'small', 'economy'])) > 0",
)
def _p9(v: Views) -> DataFrame:
    rows = v.part.withColumn("tags", F.array(F.lower("p_type")))
    return rows.filter(excluded_by_words("p_name", "tags", ["red", "small", "economy"])).select("p_partkey")


@query(
    "p10_single_class",
    """SELECT p_partkey, CASE WHEN a = 'brown' OR b = 'brown' THEN NULL WHEN x IS NOT NULL AND y IS NOT NULL AND x <> y THEN 'ambiguous' WHEN x IS NOT NULL OR y IS NOT NULL THEN coalesce(x, y) WHEN b IN ('widget', 'gear') THEN 'thing' ELSE 'unmapped' END AS class_name FROM (
    SELECT *, CASE a WHEN 'red' THEN 'warm' WHEN 'blue' THEN 'cold' END AS x, CASE b WHEN 'bolt' THEN 'cold' WHEN 'ring' THEN 'warm' END AS y FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part))""",
)
def _p10(v: Views) -> DataFrame:
    found = single_class("labels", {"red": "warm", "blue": "cold", "bolt": "cold", "ring": "warm"}, {"widget": "thing", "gear": "thing"}, ["brown"])
    return v.part.withColumn("labels", F.split("p_name", " ")).select("p_partkey", found.alias("class_name"))


@query("p11_known_class_rows", "SELECT clip_no FROM {clips} WHERE split = 'test' AND class_name IN (SELECT class_name FROM {clips} WHERE split = 'train' AND priority = 1)")
def _p11(v: Views) -> DataFrame:
    known = v.clips.filter("split = 'train' AND priority = 1").select("class_name").distinct()
    return v.clips.filter("split = 'test'").join(known, "class_name", "left_semi").select("clip_no")


@query("j1_label_mapping", "SELECT clip_no, m AS mapped FROM {clips} JOIN (VALUES ('BUILDING', 'a'), ('MACHINERY', 'b'), ('HOUSEHOLD', 'a')) t(l, m) ON l = class_name")
def _j1(v: Views) -> DataFrame:
    label_map = v.spark.createDataFrame([("BUILDING", "a"), ("MACHINERY", "b"), ("HOUSEHOLD", "a"), ("FURNITURE", None)], "label string, class_name string")
    rows = v.clips.select("clip_no", F.col("class_name").alias("label"))
    return map_labels(rows, label_map, ["label"]).select("clip_no", F.col("class_name").alias("mapped"))


@query(
    "j2_reference_by_hash",
    "SELECT r.record_id, l.quality AS reference FROM {records} r LEFT JOIN (SELECT sha256, max(quality) AS quality FROM {records} JOIN labels ON doc_id = record_id GROUP BY sha256) l ON l.sha256 = r.sha256",
)
def _j2(v: Views) -> DataFrame:
    known = v.records.join(v.labels, F.col("record_id") == F.col("doc_id")).groupBy("sha256").agg(F.max("quality").alias("reference"))
    return v.records.join(known, "sha256", "left").select("record_id", "reference")


@query(
    "j3_rule_lookup",
    f"SELECT event_id, coalesce(q.severity, 'Informational') AS severity, coalesce(q.alert, false) AS alert, coalesce(q.min_confidence, 0.6) AS least FROM {{sound_events}} e LEFT JOIN {rule_sql()} q ON q.category = e.final_class AND q.category NOT IN ('Gunshot', 'Vehicle Horn')",
)
def _j3(v: Views) -> DataFrame:
    """One rule is missing and one disabled."""
    rules = rule_table(v.spark).filter("category <> 'Gunshot'").withColumn("enabled", F.col("category") != "Vehicle Horn")
    rows = with_rule(v.sound_events, rules, "final_class")
    return rows.select("event_id", F.col("rule_severity").alias("severity"), F.col("rule_alert").alias("alert"), F.col("rule_min_confidence").alias("least"))


@query(
    "j4_exact_duplicates",
    "SELECT record_id, duplicate_of FROM (SELECT record_id, first_value(record_id) OVER (PARTITION BY sha256 ORDER BY uploaded_s, record_id) AS duplicate_of FROM {records}) WHERE record_id <> duplicate_of",
)
def _j4(v: Views) -> DataFrame:
    return exact_duplicates(v.records, "sha256", ["uploaded_s"], "record_id")


@query(
    "j7_metadata_enrichment",
    "SELECT clip_no, coalesce(nullif(m.g, ''), nullif(m.r, ''), c.path) AS group_key FROM {clips} c LEFT JOIN (SELECT path AS p, CASE WHEN clip_no % 3 = 0 THEN group_id ELSE '' END AS g, origin_id AS r FROM {clips} WHERE clip_no % 2 = 0) m ON m.p = c.path",
)
def _j7(v: Views) -> DataFrame:
    meta = v.clips.filter("clip_no % 2 = 0").select("path", F.when(F.col("clip_no") % 3 == 0, F.col("group_id")).otherwise("").alias("given_group"), F.col("origin_id").alias("recording"))
    return metadata_enriched(v.clips, meta).select("clip_no", "group_key")


@query("j10_new_files_only", "SELECT clip_no FROM {clips} WHERE path NOT IN (SELECT path FROM {clips} WHERE split = 'train' AND clip_no % 4 = 0) AND sha256 NOT IN (SELECT sha256 FROM {clips} WHERE split = 'train' AND clip_no % 4 = 0)")
def _j10(v: Views) -> DataFrame:
    return new_files(v.clips, v.clips.filter("split = 'train' AND clip_no % 4 = 0")).select("clip_no")


_OF = "CAST(clip_no // 40 AS VARCHAR)"
_POOL = f"(SELECT path, {_OF} AS o, row_number() OVER (ORDER BY {_OF}, path) - 1 AS i, count(*) OVER () AS n FROM {{clips}} WHERE class_name = 'MACHINERY')"


@query(
    "j13_noise_partners",
    f"""WITH p AS {_POOL}, r AS (SELECT o, max(i) + 1 AS e FROM p GROUP BY o) SELECT c.clip_no, CASE WHEN a.o = c.o THEN b.path ELSE a.path END AS partner FROM (SELECT clip_no, {_OF} AS o FROM {{clips}}) c
    JOIN p a ON a.i = c.clip_no % a.n JOIN r ON r.o = a.o JOIN p b ON b.i = r.e % b.n""",
)
def _j13(v: Views) -> DataFrame:
    """Forty clips in a row stand for one recording."""
    rows = v.clips.withColumn("of", F.expr("CAST(clip_no div 40 AS STRING)"))
    return noise_partners(rows, rows.filter("class_name = 'MACHINERY'"), recording="of").select("clip_no", "partner")


@query(
    "a11_class_statistics",
    """SELECT s.*, coalesce(m.sources, '') AS sources FROM (SELECT class_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(*) AS total,
    count(DISTINCT origin_id) AS recordings, round(sum(duration_s), 3) AS seconds FROM {clips} GROUP BY ROLLUP (class_name)) s
    LEFT JOIN (SELECT class_name, string_agg(source || '=' || n, '; ' ORDER BY source) AS sources FROM (SELECT class_name, source, count(*) AS n FROM {clips} GROUP BY ALL) GROUP BY class_name) m ON m.class_name = s.class_name""",
)
def _a11(v: Views) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")
    return class_statistics(v.clips).withColumn("sources", F.coalesce(shown, F.lit("")))


@query(
    "a12_reject_kinds",
    "SELECT CASE WHEN duration_s < 0.3 THEN 'too short' ELSE 'silent' END AS kind, count(*) AS n FROM {clips} WHERE duration_s < 0.3 OR peak < 0.05 GROUP BY 1",
)
def _a12(v: Views) -> DataFrame:
    rows = v.clips.withColumn("size", F.lit(1)).withColumn("reason", rejection_reason("duration_s", "peak", "size", silence_peak=0.05))
    return rows.filter("reason IS NOT NULL").groupBy(reason_kind("reason").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "a13_balance_warnings",
    """WITH rows AS (SELECT class_name, origin_id, split FROM {clips} WHERE NOT (class_name = 'MACHINERY' AND clip_no % 3 > 0) AND NOT (class_name = 'BUILDING' AND split = 'test')),
    s AS (SELECT class_name, count(*) AS t, count(DISTINCT origin_id) AS r, count(*) FILTER (split = 'validation') AS va, count(*) FILTER (split = 'test') AS te, count(*) FILTER (split = 'train') AS tr FROM rows GROUP BY class_name),
    m AS (SELECT coalesce(t, 0) AS t FROM (VALUES ('BUILDING'), ('MACHINERY'), ('GARDEN')) AS x(c) LEFT JOIN s ON c = class_name)
    SELECT class_name, 'clips short by ' || 280 - t AS warning FROM s WHERE t < 280 UNION ALL SELECT class_name, 'recordings short by ' || 280 - r FROM s WHERE r < 280 UNION ALL SELECT 'GARDEN', 'no clips'
    UNION ALL SELECT class_name, 'no clips in ' || concat_ws(', ', CASE WHEN tr = 0 THEN 'train' END, CASE WHEN va = 0 THEN 'validation' END, CASE WHEN te = 0 THEN 'test' END) FROM s WHERE tr * va * te = 0
    UNION ALL SELECT '', 'imbalance: ' || min(t) || ' of ' || max(t) FROM m HAVING min(t) < 0.8 * max(t)""",
)
def _a13(v: Views) -> DataFrame:
    rows = v.clips.filter("NOT (class_name = 'MACHINERY' AND clip_no % 3 > 0) AND NOT (class_name = 'BUILDING' AND split = 'test')")
    return balance_warnings(class_statistics(rows), 280, ["BUILDING", "MACHINERY", "GARDEN"])


@query(
    "a14_quality_grades",
    "SELECT class_name, " + ", ".join(f"count(*) FILTER (quality_grade = '{g}') AS \"{g}\"" for g in ("Good", "Acceptable", "Poor", "Unusable")) + " FROM {clips} GROUP BY class_name",
)
def _a14(v: Views) -> DataFrame:
    return quality_summary(v.clips)[0]


@query("a14_issue_kinds", "SELECT split_part(i, ':', 1) AS kind, count(*) AS n FROM (SELECT unnest(string_split(quality_issues, '; ')) AS i FROM {clips} WHERE quality_issues <> '') GROUP BY 1")
def _a14b(v: Views) -> DataFrame:
    return quality_summary(v.clips)[1]


@query("a15_candidate_scan", "SELECT class_name, source, count(*) AS files, count(DISTINCT origin_id) AS recordings FROM {clips} GROUP BY GROUPING SETS ((class_name, source), (class_name))")
def _a15(v: Views) -> DataFrame:
    return scan(v.clips)


@query(
    "a16_segment_counts",
    "SELECT class_name, " + ", ".join(f"count(*) FILTER (split = '{s}' AND priority = {c}) AS {s}{'_copies' if c else ''}" for s in SPLITS for c in (0, 1)) + " FROM {clips} GROUP BY class_name",
)
def _a16(v: Views) -> DataFrame:
    return segment_counts(v.clips.withColumn("is_copy", F.col("priority") == 1), "is_copy")


@query(
    "a17_label_conflicts",
    "SELECT group_id, string_agg(DISTINCT class_name, ', ' ORDER BY class_name) AS labels FROM {clips} GROUP BY group_id HAVING count(DISTINCT class_name) > 1",
)
def _a17(v: Views) -> DataFrame:
    return label_conflicts(v.clips)


@query(
    "a17_conflicts_dropped",
    """WITH k AS (SELECT clip_no, class_name, group_id || clip_no % 40 AS g FROM {clips}), b AS (SELECT g, string_agg(DISTINCT class_name, ' vs ' ORDER BY class_name) AS l FROM k GROUP BY g HAVING count(DISTINCT class_name) > 1)
    SELECT clip_no, CASE WHEN l IS NULL THEN '' ELSE 'label conflict (' || l || ')' END AS reason FROM k LEFT JOIN b ON b.g = k.g""",
)
def _a17b(v: Views) -> DataFrame:
    rows = v.clips.withColumn("group_id", F.concat("group_id", (F.col("clip_no") % 40).cast("string")))
    kept, rejected = drop_conflicts(rows)
    return kept.select("clip_no", F.lit("").alias("reason")).unionByName(rejected.select("clip_no", "reason"))


@query("a18_leaked_groups", "SELECT group_id, count(DISTINCT split) AS splits FROM {clips} GROUP BY group_id HAVING count(DISTINCT split) > 1")
def _a18(v: Views) -> DataFrame:
    return leaked_groups(v.clips)


@query("a36_unknown_labels", "SELECT DISTINCT class_name FROM {clips} WHERE class_name NOT IN ('BUILDING', 'MACHINERY')")
def _a36(v: Views) -> DataFrame:
    vocabulary = v.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "class_name string")
    return missing_labels(v.clips, vocabulary, "class_name")


_ORDER = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, source, path"


@query(
    "w5_class_codes",
    f"""SELECT clip_no, upper(substr(class_name, 1, 3)) || '-' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END AS audio_id
    FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY {_ORDER}) + CASE class_name WHEN 'MACHINERY' THEN 99990 WHEN 'BUILDING' THEN 7 ELSE 0 END AS n FROM {{clips}})""",
)
def _w5(v: Views) -> DataFrame:
    """Two classes go on after ids that are there, one of them beyond five digits."""
    start = v.spark.createDataFrame([("MACHINERY", 99_990), ("MACHINERY", 5), ("BUILDING", 7)], "class_name string, last_no long")
    return class_codes(v.clips, [split_rank(), "source", "path"], start=start).select("clip_no", "audio_id")


@query(
    "w6_diverse_selection",
    """SELECT clip_no, place FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY round, priority, md5('42:' || group_id), group_id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY class_name, group_id ORDER BY priority, md5('42:' || path), path) AS round FROM {clips})) WHERE place <= 60""",
)
def _w6(v: Views) -> DataFrame:
    return diverse_selection(v.clips, 60).select("clip_no", "place")


@query("w7_first_per_class", "SELECT clip_no, place FROM (SELECT clip_no, row_number() OVER (PARTITION BY class_name ORDER BY md5('7:' || path), path) AS place FROM {clips}) WHERE place <= 20")
def _w7(v: Views) -> DataFrame:
    return first_per_class(v.clips, 20, "class_name", [stable_order("7", "path"), "path"]).select("clip_no", "place")


@query(
    "w9_copy_plan",
    """SELECT class_name, path, unnest(range(1, c + 1)) AS copy_no FROM (SELECT class_name, path, CAST(least(need // n + CASE WHEN place <= need % n THEN 1 ELSE 0 END, 2) AS INTEGER) AS c FROM (
    SELECT *, greatest(500 - n, 0) AS need FROM (SELECT class_name, path, count(*) OVER (PARTITION BY class_name) AS n, row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || path), path) AS place FROM {clips})))""",
)
def _w9(v: Views) -> DataFrame:
    return plan_copies(v.clips, 500, 2).withColumn("copy_no", F.col("copy_no").cast("long"))


@query(
    "w12_latest_versions",
    """SELECT family, arg_max(name, (d, n)) AS latest FROM (SELECT 'm' || (o_custkey % 9) AS family, strftime(o_orderdate, '%Y%m%d') AS d, o_orderkey % 12 AS n, 'm' || (o_custkey % 9) || '-' || strftime(o_orderdate, '%Y%m%d') || '-' || (o_orderkey % 12) AS name FROM orders) GROUP BY family""",
)
def _w12(v: Views) -> DataFrame:
    name = F.concat(F.lit("m"), (F.col("o_custkey") % 9).cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), (F.col("o_orderkey") % 12).cast("string"))
    return latest_versions(v.orders.select(name.alias("name")))


@query("s1_union_with_flag", "SELECT path, false AS is_copy FROM {clips} WHERE split = 'train' UNION ALL SELECT path, true FROM {clips} WHERE split = 'train' AND priority = 1")
def _s1(v: Views) -> DataFrame:
    train = v.clips.filter("split = 'train'")
    return train.select("path", F.lit(False).alias("is_copy")).unionByName(train.filter("priority = 1").select("path", F.lit(True).alias("is_copy")), allowMissingColumns=True)


def _greedy_sql(groups: str) -> str:
    """Splits by the rule itself, one group after the other, in integers: (class_name, group_id, n, split) of groups (class_name, group_id, n)."""
    return f"""(WITH RECURSIVE g AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY n DESC, md5('42:' || group_id), group_id) AS i FROM {groups}),
    d AS (SELECT class_name, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, 0 AS pick, CAST(0 AS BIGINT) AS c0, CAST(0 AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2 FROM (SELECT DISTINCT class_name FROM g) UNION ALL
    SELECT class_name, i, n, p, c0 + CASE p WHEN 0 THEN n ELSE 0 END, c1 + CASE p WHEN 1 THEN n ELSE 0 END, c2 + CASE p WHEN 2 THEN n ELSE 0 END FROM (
    SELECT g.class_name, g.i, g.n, c0, c1, c2, CASE WHEN 15 * c0 <= 70 * c1 AND 15 * c0 <= 70 * c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS p FROM d JOIN g ON g.class_name = d.class_name AND g.i = d.i + 1)),
    k AS (SELECT class_name, n, count(*) FILTER (pick = 0) AS a, count(*) FILTER (pick < 2) AS b FROM d WHERE i > 0 GROUP BY class_name, n)
    SELECT o.class_name, group_id, o.n, CASE WHEN j <= a THEN 'train' WHEN j <= b THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY class_name, n ORDER BY i) AS j FROM g) o JOIN k ON k.class_name = o.class_name AND k.n = o.n)"""


_OLD = """old AS (SELECT clip_no, path, sha256, class_name, group_id, min(split) OVER (PARTITION BY group_id) AS split, upper(substr(class_name, 1, 3)) || '-' || lpad(CAST(row_number() OVER (PARTITION BY class_name ORDER BY clip_no) AS VARCHAR), 5, '0') AS audio_id
    FROM (SELECT * REPLACE (group_id || ':' || clip_no % 5 AS group_id) FROM {clips}) WHERE clip_no % 3 = 0)"""
_FRESH = """cand AS (SELECT * FROM (SELECT * REPLACE (group_id || ':' || clip_no % 5 AS group_id) FROM {clips}) WHERE clip_no % 2 = 0 AND path NOT IN (SELECT path FROM old)),
    fresh AS (SELECT * FROM cand n WHERE sha256 NOT IN (SELECT sha256 FROM old) AND path = (SELECT min(path) FROM cand m WHERE m.sha256 = n.sha256)),
    per AS (SELECT class_name, group_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY class_name) AS total FROM fresh GROUP BY class_name, group_id),
    owned AS (SELECT group_id, class_name, n FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total DESC, class_name) AS r FROM per) WHERE r = 1),
    undecided AS (SELECT class_name, group_id, n FROM owned WHERE group_id NOT IN (SELECT group_id FROM old))"""
_DECIDED = f"""decided AS (SELECT group_id, split FROM {_greedy_sql("undecided")} UNION ALL SELECT group_id, min(split) FROM old GROUP BY group_id)"""


@query(
    "s2_extend_dataset",
    f"""WITH {_OLD}, {_FRESH}, {_DECIDED} SELECT clip_no, split, audio_id, false AS added FROM old UNION ALL
    SELECT clip_no, split, upper(substr(class_name, 1, 3)) || '-' || lpad(CAST(last + row_number() OVER (PARTITION BY class_name ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, path) AS VARCHAR), 5, '0'), true
    FROM (SELECT f.clip_no, f.path, f.class_name, d.split, coalesce(l.last, 0) AS last FROM fresh f JOIN decided d ON d.group_id = f.group_id LEFT JOIN (SELECT class_name, count(*) AS last FROM old GROUP BY class_name) l ON l.class_name = f.class_name)""",
)
def _s2(v: Views) -> DataFrame:
    return extend_dataset(*_extension(v))[0].select("clip_no", "split", "audio_id", "added")


def _extension(v: Views) -> tuple[DataFrame, DataFrame]:
    """A third of the clips as the dataset, half of all clips as the batch; groups of few clips, some shared by classes."""
    rows = v.clips.withColumn("group_id", F.concat_ws(":", "group_id", (F.col("clip_no") % 5).cast("string")))
    rows = rows.select("clip_no", "path", "sha256", "class_name", "group_id", "split")
    known = rows.filter("clip_no % 3 = 0")
    splits = known.groupBy("group_id").agg(F.min("split").alias("split"))
    old = class_codes(known.drop("split").join(splits, "group_id"), ["clip_no"])
    return settled(old.select("clip_no", "path", "sha256", "class_name", "group_id", "split", "audio_id")), rows.filter("clip_no % 2 = 0")


@query(
    "s2_extension_rejects",
    f"""WITH {_OLD}, {_FRESH} SELECT clip_no, 'exact duplicate (of ' || coalesce((SELECT min(path) FROM old o WHERE o.sha256 = c.sha256), (SELECT min(path) FROM cand m WHERE m.sha256 = c.sha256)) || ')' AS reason FROM cand c WHERE clip_no NOT IN (SELECT clip_no FROM fresh)""",
)
def _s2b(v: Views) -> DataFrame:
    return extend_dataset(*_extension(v))[1].select("clip_no", "reason")


@query("s2_extension_leaks", f"WITH {_OLD}, {_FRESH}, {_DECIDED} SELECT g AS group_id, CAST(n AS INTEGER) AS splits FROM (SELECT group_id AS g, count(DISTINCT split) AS n FROM (SELECT group_id, split FROM old UNION ALL SELECT f.group_id, d.split FROM fresh f JOIN decided d ON d.group_id = f.group_id) GROUP BY group_id) WHERE n > 1")
def _s2c(v: Views) -> DataFrame:
    return leaked_groups(extend_dataset(*_extension(v))[0]).select("group_id", F.col("splits").cast("int").alias("splits"))


@query("g2_extended_splits", f"WITH {_OLD}, {_FRESH}, {_DECIDED} SELECT group_id, split FROM decided WHERE group_id IN (SELECT group_id FROM fresh)")
def _g2(v: Views) -> DataFrame:
    old, new = _extension(v)
    return extension_splits(new_rows(old, new.drop("split"))[0], old)


@query("s3_replace_rows", "SELECT path, clip_no FROM {clips} WHERE clip_no % 5 <> 0 UNION ALL SELECT path, -clip_no FROM {clips} WHERE clip_no % 5 = 0")
def _s3(v: Views) -> DataFrame:
    fresh = v.clips.filter("clip_no % 5 = 0").select("path", (-F.col("clip_no")).alias("clip_no"))
    return replace_rows(v.clips.select("path", "clip_no"), fresh, "path")


_UNMIXED = """(SELECT clip_no, class_name, group_id FROM (SELECT clip_no, class_name, group_id || ':' || clip_no % 4 AS group_id FROM {clips}) WHERE group_id NOT IN (SELECT group_id FROM (SELECT class_name, group_id || ':' || clip_no % 4 AS group_id FROM {clips}) GROUP BY group_id HAVING count(DISTINCT class_name) > 1))"""
_SIZES = f"(SELECT class_name, group_id, count(*) AS n FROM {_UNMIXED} GROUP BY ALL)"


def _unmixed(v: Views) -> DataFrame:
    """Clips whose group has one class only, as a build leaves them."""
    return drop_conflicts(v.clips.withColumn("group_id", F.concat_ws(":", "group_id", (F.col("clip_no") % 4).cast("string"))))[0]


@query("g1_group_splits", f"SELECT * FROM {_greedy_sql(_SIZES)}")
def _g1(v: Views) -> DataFrame:
    return group_splits(_unmixed(v).groupBy("class_name", "group_id").agg(F.count("*").alias("n")))


@query("g1_group_splits_leak_check", f"SELECT group_id, CAST(count(DISTINCT split) AS INTEGER) AS splits FROM (SELECT c.group_id, s.split FROM {_UNMIXED} c JOIN {_greedy_sql(_SIZES)} s ON s.group_id = c.group_id) GROUP BY group_id HAVING count(DISTINCT split) > 1")
def _g1b(v: Views) -> DataFrame:
    """No row: every clip of a group is in the split of its group."""
    rows = _unmixed(v)
    splits = group_splits(rows.groupBy("class_name", "group_id").agg(F.count("*").alias("n")))
    return leaked_groups(rows.drop("split").join(splits.select("group_id", "split"), "group_id")).select("group_id", F.col("splits").cast("int").alias("splits"))


_RULES_BAD = "SELECT c_mktsegment || (c_custkey % 40000) AS category, CASE WHEN c_custkey % 50 = 0 THEN 'Huge' ELSE 'Low' END AS severity, CASE WHEN c_custkey % 60 = 7 THEN 'Best' ELSE 'Poor' END AS grade, c_custkey % 40 AS conf, c_custkey % 70 AS reps FROM customer UNION ALL SELECT 'BUILDING' || c_custkey, 'Low', 'Poor', 0, 1 FROM customer WHERE c_custkey % 31 = 0"


@query(
    "p13_rule_violations",
    f"""WITH r AS ({_RULES_BAD}) SELECT category, 'severity' AS problem FROM r WHERE severity = 'Huge' UNION ALL SELECT category, 'grade' FROM r WHERE grade = 'Best' UNION ALL SELECT category, 'range' FROM r WHERE conf > 30
    UNION ALL SELECT category, 'repeats' FROM r WHERE reps = 0 UNION ALL SELECT category, 'repeated' FROM r GROUP BY category HAVING count(*) > 1""",
)
def _p13(v: Views) -> DataFrame:
    n = F.col("c_custkey")
    rules = v.customer.select(
        F.concat("c_mktsegment", (n % 40000).cast("string")).alias("category"), F.when(n % 50 == 0, "Huge").otherwise("Low").alias("severity"), F.when(n % 60 == 7, "Best").otherwise("Poor").alias("min_quality"),
        ((n % 40) / 30).alias("min_confidence"), F.lit(0.1).alias("top_two_margin"), (n % 70).alias("consecutive_detections"),
    )
    more = v.customer.filter("c_custkey % 31 = 0").select(
        F.concat(F.lit("BUILDING"), n.cast("string")).alias("category"), F.lit("Low").alias("severity"), F.lit("Poor").alias("min_quality"), F.lit(0.0).alias("min_confidence"), F.lit(0.1).alias("top_two_margin"), F.lit(1).alias("consecutive_detections"),
    )
    return rule_violations(rules.unionByName(more), SEVERITIES, GRADES)


@query("p13_label_map_violations", "SELECT source, group_id AS label, 'unknown class ' || class_name AS problem FROM {clips} WHERE priority = 1 AND class_name NOT IN ('BUILDING', 'MACHINERY')")
def _p13b(v: Views) -> DataFrame:
    classes = v.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "name string")
    label_map = v.clips.select("source", F.col("group_id").alias("label"), F.when(F.col("priority") == 1, F.col("class_name")).alias("class_name"))
    return label_map_violations(label_map, classes)


@query("p13_class_violations", "SELECT field, value, count(*) AS n FROM (SELECT 'name' AS field, path AS value FROM {clips} UNION ALL SELECT 'slug', group_id FROM {clips} UNION ALL SELECT 'code', origin_id FROM {clips}) GROUP BY field, value HAVING count(*) > 1")
def _p13c(v: Views) -> DataFrame:
    return class_violations(v.clips.select(F.col("path").alias("name"), F.col("group_id").alias("slug"), F.col("origin_id").alias("code")))
