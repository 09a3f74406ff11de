"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

The candidates of a task are cut in blocks; in a block each dimension is a list
sorted by its component.  For a query every list is read from the end that adds
most to the score, all to the same depth.  What has been read and the value at
which a list stands bound every score from above, the list's last value bounds it
from below; an outsider, not met in any list, can reach no more than the sum of
where the lists stand.  Reading goes on until neither outsiders nor more than a
few candidates can reach the query's k-th best lower bound; their scores are then
resolved in 64-bit integers.  The k-th score of the blocks read before is a lower
bound too.  Bounds of all queries of a group are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.llm.storage import materialise
from auralake.llm.vectors import matrices, scaled, usable

#: Rows of a block of sorted lists, and queries whose bounds are one matrix.
BLOCK, GROUP = 2_048, 256
#: Steps in which the lists are read to their end.
STEPS = 8
#: Components of the queries of one broadcast round (16 MB); more queries are asked in more rounds.
ROUND_VALUES = 2_000_000
#: Pairs whose scores are resolved at once.
RESOLVED = 1 << 15


class SortedLists:
    """The lists of one block: `ordered` is each dimension's components in rising order, `rank` each entry's place in its list."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.ordered = np.take_along_axis(x, order, axis=0).astype(float)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(x))[:, None], axis=0)

    def stands(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The values last read at this depth, from the top and from the bottom of each list."""
        return self.ordered[len(self.x) - depth], self.ordered[depth - 1]

    def bounds(self, depth: int, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        """For lists read from the top and from the bottom: the entries read, and for the others a bound of theirs."""
        top, bottom = self.stands(depth) if upper else (self.ordered[0], self.ordered[-1])
        value = self.x.astype(float)
        return np.where(self.rank >= len(self.x) - depth, value, top), np.where(self.rank < depth, value, bottom)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, k - 1, axis=1)[:, k - 1]


def qualified(lists: SortedLists, queries: np.ndarray, own: tuple[np.ndarray, np.ndarray], known: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, candidates) for each query: all candidates of the block that can be among its k best, few others.

    own: pairs (query, candidate) that are the same row; known: a lower bound of each query's k-th best score.
    """
    n = len(lists.x)
    rising, falling = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
    slack = 1e-9 * (np.abs(queries).astype(float) @ np.abs(lists.ordered).max(axis=0, initial=0.0) + 1)
    few = max(2 * k, n // 32)
    open_ = np.arange(len(queries))
    for step in range(1, STEPS + 1):
        depth = max(1, n * step // STEPS)
        fresh = open_[~np.isfinite(known[open_])]
        if len(fresh):
            from_top, from_bottom = lists.bounds(depth, upper=False)
            low = rising[fresh] @ from_top.T + falling[fresh] @ from_bottom.T
            place = np.full(len(queries), -1)
            place[fresh] = np.arange(len(fresh))
            mine = place[own[0]] >= 0
            low[place[own[0][mine]], own[1][mine]] = -np.inf
            bound = _kth(low, k)
        reach = known.copy()
        if len(fresh):
            reach[fresh] = bound
        reach = reach - slack
        top, bottom = lists.stands(depth)
        outsider = rising[open_] @ top + falling[open_] @ bottom
        closed = open_ if step == STEPS else open_[outsider < reach[open_]]  # no outsider qualifies
        if not len(closed):
            continue
        from_top, from_bottom = lists.bounds(depth, upper=True)
        able = rising[closed] @ from_top.T + falling[closed] @ from_bottom.T >= reach[closed][:, None]
        settled = (able.sum(axis=1) <= few) | (step == STEPS)
        for q in np.flatnonzero(settled):
            yield int(closed[q]), np.flatnonzero(able[q])
        open_ = np.setdiff1d(open_, closed[settled], assume_unique=True)
        if not len(open_):
            return


class _Best:
    """The k best candidates of each query so far: highest score, then smallest id (no id last), then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.known = np.full(queries, -np.inf)
        self.rows = [np.empty(0, dtype=np.int64) for _ in range(5)]  # query, score, no_id, id, row

    def add(self, found: list[np.ndarray]) -> None:
        merged = [np.concatenate(pair) for pair in zip(self.rows, found, strict=True)]
        query, score, no_id, own, row = merged
        order = np.lexsort((row, own, no_id, ~score, query))  # ~: falls as the score rises
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.rows = [m[order][rank < self.k] for m in merged]
        last = rank == self.k - 1
        self.known[query[last]] = score[order][last]


_ROW = "query_row long, query_id long, score long, no_id int, vec_id long, row long"


def _search(queries: pa.Table, k: int):
    """Function for mapInArrow over candidates (row, vec_id, x): the k best of a partition for each query."""
    q_row, q_id = (queries.column(c).to_numpy() for c in ("row", "vec_id"))
    by_length = {m.shape[1]: (at, m) for at, m in matrices(queries.select(["x"]).combine_chunks().to_batches(max_chunksize=len(queries))[0], "x")}

    def block(best: _Best, x: np.ndarray, row: np.ndarray, no_id: np.ndarray, vec_id: np.ndarray) -> None:
        lists = SortedLists(x)
        whole_at, whole = by_length[x.shape[1]]
        for begin in range(0, len(whole), GROUP):
            at, q = whole_at[begin : begin + GROUP], whole[begin : begin + GROUP]
            _, own_q, own_c = np.intersect1d(q_row[at], row, return_indices=True)
            found, size = [], 0
            for i, some in (*qualified(lists, q, (own_q, own_c), best.known[at], k), (-1, np.empty(0, dtype=np.int64))):
                if i < 0 or size + len(some) > RESOLVED:
                    if found:
                        first, second = (np.concatenate(p) for p in zip(*found, strict=True))
                        other = q_row[at[first]] != row[second]
                        first, second = first[other], second[other]
                        score = np.einsum("ij,ij->i", q[first], x[second])
                        best.add([at[first], score, no_id[second], vec_id[second], row[second]])
                    found, size = [], 0
                found.append((np.full(len(some), i), some))
                size += len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(q_row), k)
        for batch in batches:
            row = batch.column("row").to_numpy()
            no_id = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            vec_id = batch.column("vec_id").fill_null(0).to_numpy()
            for at, x in matrices(batch, "x"):
                if x.shape[1] in by_length:
                    for begin in range(0, len(at), BLOCK):
                        some = at[begin : begin + BLOCK]
                        block(best, x[begin : begin + BLOCK], row[some], no_id[some], vec_id[some])
        query, score, no_id, vec_id, row = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (q_row[query], q_id[query], score, no_id.astype(np.int32), vec_id, row)],
            names=[c.split()[0] for c in _ROW.split(", ")],
        )

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for each query row, over floor(scale * component).

    Every row but the query's own is a candidate; ties go to the smaller vec_id,
    rows without one come last; fewer candidates give fewer rows.  Rows count by
    themselves: of rows that repeat an id each is a candidate, and each asks its
    own question.  Vectors that are null or hold null or non-finite entries take
    no part; vectors of another length than the query's are no candidates.
    Scores are 64-bit integers.  Other columns are ignored; an empty table, or
    one without queries, gives no rows.  Queries are broadcast in rounds of about
    ROUND_VALUES components; candidates are read once a round and never
    shuffled, only k rows per query and task are.
    """
    spark = vectors.sparkSession
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    found = found.filter(usable(F.col("v"))).select("vec_id", "asks", scaled(F.col("v"), scale).alias("x"))
    found = found.withColumn("row", F.monotonically_increasing_id())
    rows = materialise(found, "vectors")
    n, asked, values = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.sum(F.when(F.col("asks"), F.size("x"))), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    parts = -(-n // min(1 << 17, max(BLOCK, -(-n // (2 * cores)))))
    candidates = materialise(rows.repartition(max(1, parts)).select("row", "vec_id", "x"), "candidates")
    told = spark.createDataFrame([], _ROW)
    rounds = -(-values // ROUND_VALUES) if values else int(asked > 0)
    for r in range(rounds):
        chosen = rows.filter("asks").filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("row", "vec_id", "x").toArrow()
        if chosen.num_rows:
            told = told.unionByName(candidates.mapInArrow(_search(chosen, k), _ROW))
    told = materialise(told, "found")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "no_id", "vec_id", "row")
    ranked = told.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("no_id") == 0, F.col("vec_id")).alias("vec_id"), "score")
