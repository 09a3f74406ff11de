"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run of period q holds each of its words at least as often as it repeats, so a
word that occurs fewer times within a segment lies in no run there: such words
split the segment, and its parts, in which other words have become too rare, are
split again until nothing changes.  In the segments that survive, windows of 1,
2, 4, ... words are named by doubling; within a run of period q the next equal
window of the first power of two from q on stands exactly q words further, so
stretches of one such distance tell the lags at which a segment is scanned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that one numpy pass handles; a longer text makes a pass of its own.
PASS_WORDS = 1 << 18
RUNS = "array<struct<start:long,length:long,period:long>>"


def surviving_segments(ids: np.ndarray, doc: np.ndarray, times: int, shortest: int) -> np.ndarray:
    """(start, end) of the segments in which every word occurs `times` times or more; none spans two documents."""
    done = [np.empty((0, 2), dtype=np.int64)]
    at, seg, most = np.arange(len(ids)), doc, int(ids.max(initial=0)) + 1
    while len(at):
        _, inverse, n = np.unique(seg * most + ids[at], return_inverse=True, return_counts=True)
        frequent = n[inverse] >= times
        split = np.bincount(seg, weights=~frequent) > 0
        at, seg = at[frequent], seg[frequent]
        first = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(seg, prepend=-1) != 0))
        size = np.diff(np.append(first, len(at)))
        settled = ~split[seg[first]]
        long = size >= shortest
        done.append(np.stack((at[first], at[first] + size), axis=1)[settled & long])
        again = np.repeat(~settled & long, size)
        seg = np.repeat(np.cumsum(~settled & long) - 1, size)[again]
        at = at[again]
    return np.concatenate(done)


def likely_lags(names: np.ndarray, longest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of every stretch of positions whose window comes next after `lag` words.

    Every run of the length times * lag or more has such a stretch within it.
    Words that must not be matched have names of their own.
    """
    places, lags, k, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 1, len(names)
    while times * (k // 2 + 1) <= longest:
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        gap = np.zeros(n, dtype=np.int64)
        gap[order[:-1][same]] = np.diff(order)[same]
        first = np.flatnonzero(np.diff(gap, prepend=-1))
        stretch, lag = np.diff(np.append(first, n)), gap[first]
        hit = (lag > k // 2) & (lag <= k) & (stretch > (times - 3) * lag)
        places.append(first[hit])
        lags.append(lag[hit])
        following = np.concatenate((names[k:], n + np.arange(min(k, n))))
        names = np.unique(names * (2 * n) + following, return_inverse=True)[1]
        k *= 2
    return np.concatenate(places), np.concatenate(lags)


def runs_at(words: np.ndarray, lag: int, shortest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the maximal stretches of at least `shortest` words in which words `lag` apart are equal."""
    equal = np.zeros(len(words) - lag + 2, dtype=np.int8)
    equal[1:-1] = words[:-lag] == words[lag:]
    edge = np.diff(equal)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for i in np.flatnonzero(ends - starts + lag >= shortest):
        yield int(starts[i]), int(ends[i] - starts[i]) + lag


def word_runs(ids: np.ndarray, doc: np.ndarray, times: int, shortest: int) -> dict[int, list[tuple[int, int, int]]]:
    """By document, the runs (start in ids, length, smallest period) by start, then period."""
    segments = surviving_segments(ids, doc, times, max(shortest, times))
    if not len(segments):
        return {}
    size = segments[:, 1] - segments[:, 0]
    base = np.cumsum(size + 1) - (size + 1)  # a separator follows each segment
    owner = np.repeat(np.arange(len(segments)), size + 1)
    inside = np.ones(len(owner), dtype=bool)
    inside[base + size] = False
    joined = np.empty(len(owner), dtype=np.int64)
    joined[inside] = ids[np.concatenate([np.arange(s, e) for s, e in segments])]
    joined[~inside] = int(ids.max()) + 1 + np.arange(len(segments))
    names = np.unique(joined, return_inverse=True)[1]
    place, lag = likely_lags(names, int(size.max()), times)
    found: dict[tuple[int, int], int] = {}
    for s, q in sorted(set(zip(owner[place].tolist(), lag.tolist(), strict=True)), key=lambda x: x[1]):
        begin, end = segments[s]
        if times * q <= end - begin:
            for start, length in runs_at(ids[begin:end], q, max(shortest, times * q)):
                found.setdefault((int(begin) + start, length), q)  # with a smaller period it isn't a run of q
    out = defaultdict(list)
    for start, length, q in sorted((*run, q) for run, q in found.items()):
        out[int(doc[start])].append((start, length, q))
    return out


def _describe(ids: list, tokens: list[list[bytes]], times: int, shortest: int) -> pd.DataFrame:
    number: dict[bytes, int] = defaultdict(count().__next__)
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(size.sum()))
    found = word_runs(words, np.repeat(np.arange(len(tokens)), size), times, shortest)
    first = np.cumsum(size) - size
    runs, kept = [], []
    for i, own in enumerate(tokens):
        here = [(start - int(first[i]), length, q) for start, length, q in found.get(i, ())]
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
        if here:
            stays = np.ones(len(own), dtype=bool)
            for s, n, q in here:
                stays[s + q : s + n] = False
            own = [own[j] for j in np.flatnonzero(stays)]
        kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"doc_id": ids, "n_words": size, "runs": runs, "collapsed": kept})


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 4, shortest: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of docs.

    Words are runs without ASCII white space, case counts.  runs lists every
    maximal stretch (start, length, period) of at least `shortest` words and
    `times` (three or more) times its smallest period, by start, then period;
    collapsed joins by a space the words that no run holds after its first
    period.  Null and wordless texts have no runs and an empty collapsed text;
    null and repeated ids pass through; other columns are ignored; an empty
    table gives no rows.  Rows stay where they are; a text is handled whole.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, tokens, size = [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                if tokens and size + len(own) > PASS_WORDS:
                    yield _describe(ids, tokens, times, shortest)
                    ids, tokens, size = [], [], 0
                ids.append(doc_id)
                tokens.append(own)
                size += len(own)
            if tokens:
                yield _describe(ids, tokens, times, shortest)

    # ids travel as text: pandas would round large ones beside nulls
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(run, f"doc_id string, n_words long, runs {RUNS}, collapsed string")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length, of equal ones that with the smallest start, then period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    fields = (-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")
    return F.when(F.size(runs) > 0, F.struct(*fields))


def runs_text(runs: Column) -> Column:
    """One line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, the text of every tenth one (by crc32 of the id) going on periodically from some word.

    With h the checksum and g = h div 10, the words from number g % n on repeat
    with the period that gives 3 + g % 8 repeats in the rest of the text.  Rows
    with a null id and texts without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        period = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        # array, then [0]: the words are made once, not for each number
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, period)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")

    words = F.filter(F.split(text_col, r"[ \t-\r]+"), lambda w: w != "")
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)))[0]
    return docs.withColumn(text_col, F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(changed, text_col)).otherwise(F.col(text_col)))
