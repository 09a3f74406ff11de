"""Benchmark decontamination with a BM25 inverted index and block-max WAND.

The index holds the benchmark items: per term the items it occurs in with their
BM25 weight divided by the item's own full score, so scores run from 0 to 1, and
per term and block of items the largest weight.  Every training text is cut into
overlapping passages.  A passage is queried with all its words: lists of postings
stand at their next item, a pivot is the first item that the lists' largest
weights let reach the threshold, and the block maxima around it decide whether
it is scored or the lists jump behind the block.  Two bounds of the same maxima,
taken for all passages of a text at once, keep most passages from that loop: one
over the rarer terms only (the frequent ones, which can add little, count as a
constant), then one over all terms.  All items at or above the threshold are
kept, then the overlap of word triples with the item's question and answer part
is verified.  Items of like length share an index, with passages to their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.hashing import _LOWER, U64, gram_hashes, word_hashes
from auralake.llm.storage import id_long, id_text, materialise

#: Items of one broadcast index; a larger benchmark is searched in several rounds.
ROUND_ITEMS = 20_000
#: Postings of one broadcast index (about 100 MB); also a reason for more rounds.
ROUND_POSTINGS = 2_000_000
BLOCK_ITEMS = 4
_ROUNDING = 1e-9
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of digits, letters and non-ASCII bytes, A-Z lower-cased."""
    raw = (text or "").encode("utf-8").translate(_LOWER)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _INSIDE[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.diff(inside)
    return word_hashes(raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def _triples(words: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(words, min(3, len(words)))) if len(words) else np.empty(0, dtype=U64)


def index_items(benchmark: DataFrame, id_col: str, text_col: str, answer_share: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(item_id, variant, length, terms, weights, question, answer) per item and distinct text, weights normalised by its own score.

    Equal rows count once; different texts of one id are items of their own, told apart by `variant`.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, variant, text in zip(pdf["item_id"], pdf["variant"], pdf["text"], strict=True):
                h = term_hashes(text)
                cut = len(h) - max(1, round(len(h) * answer_share))
                terms, tf = np.unique(h, return_counts=True)
                rows.append((item, variant, len(h), terms.view(np.int64), tf, _triples(h[:cut]).view(np.int64), _triples(h[cut:]).view(np.int64)))
            yield pd.DataFrame(rows, columns=["item_id", "variant", "length", "terms", "tf", "question", "answer"])

    items = materialise(
        benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.sha2(text_col, 256).alias("variant"), F.col(text_col).alias("text"))
        .filter("item_id IS NOT NULL")
        .dropDuplicates(["item_id", "variant"])
        .mapInPandas(words, "item_id long, variant string, length long, terms array<long>, tf array<long>, question array<long>, answer array<long>")
        .filter("length > 0"),
        "items",
    )
    whole = items.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    posting = items.select("item_id", "variant", "length", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select(
        "item_id", "variant", "length", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf")
    )
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    weighed = (
        posting.join(df, "term")
        .join(F.broadcast(whole))  # one row
        .groupBy("item_id", "variant")
        .agg(F.sum(weight).alias("own"), F.sort_array(F.collect_list(F.struct("term", weight.alias("w")))).alias("p"))
    )
    return weighed.join(items, ["item_id", "variant"]).select(
        "item_id",
        "variant",
        "length",
        F.col("p.term").alias("terms"),
        F.transform("p", lambda x: x["w"] / F.col("own")).alias("weights"),
        "question",
        "answer",
    )


class _Cursor:
    """A term's list of postings, standing at its next item; item is -1 behind the last."""

    def __init__(self, index: ItemIndex, term: int):
        self.index, self.at, self.end = index, int(index.posting[term]), int(index.posting[term + 1])
        self.blocks = slice(int(index.start[term]), int(index.start[term + 1]))
        self.highest = float(index.highest[term])
        self.item = int(index.item[self.at])

    def advance(self, goal: int) -> None:
        """To the first posting of an item from goal on."""
        self.at += int(np.searchsorted(self.index.item[self.at : self.end], goal))
        self.item = int(self.index.item[self.at]) if self.at < self.end else -1

    def block_top(self, block: int) -> float:
        own = self.index.block[self.blocks]
        n = int(np.searchsorted(own, block))
        return float(self.index.top[self.blocks][n]) if n < len(own) and own[n] == block else 0.0

    def weight(self) -> float:
        return float(self.index.weight[self.at])


class ItemIndex:
    """Postings and block maxima of up to ROUND_ITEMS items, as flat arrays."""

    def __init__(self, rows: list, passage: int):
        self.ids = np.array([r["item_id"] for r in rows], dtype=np.int64)
        self.lengths = np.array([r["length"] for r in rows], dtype=np.int64)
        self.parts = [
            (np.array(r["question"], dtype=np.int64).view(U64), np.array(r["answer"], dtype=np.int64).view(U64)) for r in rows
        ]
        self.passage, self.blocks = passage, -(-len(rows) // BLOCK_ITEMS)
        term = np.concatenate([np.array(r["terms"], dtype=np.int64).view(U64) for r in rows])
        item = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        weight = np.concatenate([np.array(r["weights"], dtype=float) for r in rows])
        order = np.lexsort((item, term))
        self.item, self.weight, term = item[order], weight[order], term[order]
        self.terms, number = np.unique(term, return_inverse=True)
        cell = number * self.blocks + self.item // BLOCK_ITEMS
        self.first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        self.last = np.append(self.first[1:], len(cell))
        self.cell = cell[self.first]
        self.top = np.maximum.reduceat(self.weight, self.first)
        self.block = self.item[self.first] // BLOCK_ITEMS
        self.start = np.searchsorted(number[self.first], np.arange(len(self.terms) + 1))
        self.posting = np.searchsorted(number, np.arange(len(self.terms) + 1))
        self.highest = np.maximum.reduceat(self.weight, self.posting[:-1])
        self._split_terms(number, len(rows))

    def _split_terms(self, number: np.ndarray, items: int) -> None:
        """Order the frequent terms; those whose weights in any one item stay under half a threshold propose nothing (MaxScore).

        rests[k] bounds what the first k + 1 of them can add to an item's score.
        """
        df = np.bincount(number, minlength=len(self.terms))
        order = np.argsort(-df, kind="stable")
        frequent = order[df[order] > max(2, items // 50)]
        place = np.full(len(self.terms), len(frequent))
        place[frequent] = np.arange(len(frequent))
        reach = np.zeros(items)
        by_place = np.argsort(place[number], kind="stable")
        bounds = np.searchsorted(place[number][by_place], np.arange(len(frequent) + 1))
        rests = []
        for k in range(len(frequent)):
            own = by_place[bounds[k] : bounds[k + 1]]
            reach[self.item[own]] += self.weight[own]
            rests.append(float(reach.max()))
            if rests[-1] > 0.5:  # half the highest threshold
                break
        self.rests, self.place = np.array(rests), place

    def search(self, words: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
        """(item, score, first word) of every passage and item with score >= threshold, by rising score, of equal ones the first passage last."""
        step = self.passage // 2
        taken = int(np.searchsorted(self.rests, threshold / 2, side="right"))
        rest = float(self.rests[taken - 1]) if taken else 0.0
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        where = np.flatnonzero(self.terms[at] == words)
        term = at[where]
        chosen = self.place[term] >= taken  # a passage without such a term can't reach the threshold
        halves = where // step
        half, rare = halves[chosen], term[chosen]
        if not len(rare):
            return []
        key = np.concatenate((half, half[half > 0] - 1)) * len(self.terms) + np.concatenate((rare, rare[half > 0]))
        key = np.unique(key)  # one per passage and term
        place, bound = self._bounds(key // len(self.terms), key % len(self.terms))
        alive = place[bound >= threshold - rest - _ROUNDING] // self.blocks
        found = []
        for passage in np.unique(alive).tolist():
            begin, end = np.searchsorted(halves, (passage, passage + 2))
            own = np.unique(term[begin:end])
            if self._bounds(np.zeros(len(own), dtype=np.int64), own)[1].max(initial=0.0) >= threshold - _ROUNDING:
                found += [(item, score, passage * step) for item, score in self._wand(own.tolist(), threshold)]
        return sorted(found, key=lambda f: (f[1], -f[2], -f[0]))

    def _bounds(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage * blocks + block, sum of the block maxima of the passage's terms) where a term has one."""
        count = self.start[term + 1] - self.start[term]
        ends = np.cumsum(count)
        entry = np.arange(int(ends[-1])) + np.repeat(self.start[term] - (ends - count), count)
        place, at = np.unique(np.repeat(passage, count) * self.blocks + self.block[entry], return_inverse=True)
        return place, np.bincount(at, weights=self.top[entry])

    def _wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item whose weights of these terms add up to the threshold."""
        lists = [_Cursor(self, t) for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda x: x.item)
            reach, pivot = 0.0, -1
            for n, x in enumerate(lists):
                reach += x.highest
                if reach >= threshold - _ROUNDING:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[pivot].item
            while pivot + 1 < len(lists) and lists[pivot + 1].item == item:
                pivot += 1
            upto, block = lists[: pivot + 1], item // BLOCK_ITEMS
            if sum(x.block_top(block) for x in upto) < threshold - _ROUNDING:
                goal = (block + 1) * BLOCK_ITEMS  # no item of this block before the next list begins
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1].item)
            elif lists[0].item == item:
                score = sum(x.weight() for x in upto)
                if score >= threshold:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for x in upto:
                x.advance(goal)
            lists = [x for x in lists if x.item >= 0]
        return found

    def overlaps(self, item: int, words: np.ndarray, first: int) -> tuple[float, float]:
        """Shares of the question's and answer's word triples that stand around the passage."""
        margin = int(self.lengths[item])
        near = _triples(words[max(0, first - margin) : first + self.passage + margin])
        return tuple(float(np.isin(part, near).mean()) if len(part) else 1.0 for part in self.parts[item])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.5,
    overlap: float = 0.5,
    answer_share: float = 0.34,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): every verified leak, once per document and item.

    All passages of all texts are scored against all items, and those at or
    above the threshold are verified from the best down to the first that holds;
    the last answer_share of an item's words counts as its answer.  Null or empty texts
    and items leak nothing; documents with a repeated id are searched each by
    itself; of the texts of a repeated item id the best verified one is told; a
    null id stays null; empty tables give no rows.  Items are searched in rounds
    of about ROUND_ITEMS or ROUND_POSTINGS, the texts of one id in one round, so
    the broadcast index has a size bound.
    """
    spark = docs.sparkSession
    items = materialise(index_items(benchmark, item_id_col, item_text_col, answer_share), "index")
    n, postings = items.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    schema = "doc_id string, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    rows = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    rounds = max(-(-n // ROUND_ITEMS), -(-postings // ROUND_POSTINGS))
    found = spark.createDataFrame([], schema)
    for r in range(rounds):
        chosen = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r).collect() if rounds > 1 else items.collect()
        indexes = spark.sparkContext.broadcast(_by_length(chosen))

        def run(batches: Iterator[pd.DataFrame], indexes=indexes) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    best = _best_leaks(indexes.value, term_hashes(text), threshold, overlap)
                    out += [(doc_id, item_id, *found) for item_id, found in best.items()]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        part = rows.mapInPandas(run, schema)
        found = part if r == 0 else found.unionByName(part)
    return id_long(found)


def _by_length(rows: list) -> list[ItemIndex]:
    """One index for the items of up to 64 words, of up to 128, and so on; its passages are as long as its longest items may be."""
    classes: dict[int, list] = {}
    for r in sorted(rows, key=lambda x: (x["item_id"], x["variant"])):
        classes.setdefault(max(6, (r["length"] - 1).bit_length()), []).append(r)
    return [ItemIndex(own, 1 << size) for size, own in sorted(classes.items())]


def _best_leaks(indexes: list[ItemIndex], words: np.ndarray, threshold: float, overlap: float) -> dict[int, tuple]:
    """By item id, the best-scored passage of the text that is verified: (score, question overlap, answer overlap, first word)."""
    best: dict[int, tuple] = {}
    for index in indexes if len(words) else ():
        for item, score, first in reversed(index.search(words, threshold)):
            item_id = int(index.ids[item])
            if item_id in best and best[item_id][0] >= score:
                continue
            q, a = index.overlaps(item, words, first)
            if q >= overlap and a >= overlap:
                best[item_id] = (score, q, a, first)
    return best
