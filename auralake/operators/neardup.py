"""Near-duplicate recordings by fingerprint correlation.

A fingerprint is a row of frames with 16 bands each; two recordings are compared
at every alignment of the shorter one in the longer.  Candidates meet in buckets
of signs of random projections, once per table:

* recordings of one length by a projection of the whole fingerprint, so a pair is
  found by the very correlation that decides on it;
* recordings of unequal length by windows of four averages over 1, 2, 4, ...
  frames: the shorter one offers half-overlapping windows, the longer one windows
  at offsets half an average apart.  The correlation of a pair is a mean over
  scales and places, weighted by their energy, so some window is that alike:
  noise-like detail is found in short windows, slow fades in long ones.

Rows that meet are compared by 256 sign bits, and the pairs that are left by the
exact correlation over all alignments.  The number of bits of a bucket grows with
the logarithm of its rows, so that chance neighbours stay few, and the number of
tables follows from it and the wanted recall.  Nothing is capped: a bucket of
many rows is cut into blocks, all of which are compared.  The tables are worked
off a few at a time, so that the disk holds the buckets of these alone.

With a recall of 1 there are no buckets: blocks of recordings of one length meet
all blocks, by a product of matrices for each alignment.  That is quadratic, but
of what is compared nothing is shuffled but the best partner of a recording in a
pair of blocks; for a few lengths it was faster at all sizes measured.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators.ordering import settled, small
from auralake.plans.registry import Views, query

BANDS, MIN_FRAMES = 16, 4
#: Roles of a row in a bucket: a whole fingerprint, a window of the shorter recording, one of the longer.
WHOLE, SHORTER, LONGER = 0, 1, 2
#: Rows that are compared with each other in one piece.
BLOCK = 512
_SKETCH_BITS = 256
#: Tables whose buckets are on disk at once; the pairs of a round are kept, its buckets are not.
TABLES = 4
#: Recordings of a block where all pairs are compared, and partitions of blocks at most: a task for each pair of these.
RECORDINGS, PARTS = 4096, 48


def best_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Largest correlation of two (frames, bands) fingerprints over all alignments; 0 when one is too short or flat."""
    short, other = sorted((a, b), key=len)
    if len(short) < MIN_FRAMES:
        return 0.0
    view = np.lib.stride_tricks.sliding_window_view(other, short.shape).reshape(-1, short.size)
    s = short.ravel() - short.mean()
    w = view - view.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(s) * np.linalg.norm(w, axis=1)
    return float(np.divide(w @ s, norm, out=np.zeros(len(w)), where=norm > 0).max(initial=0.0))


def bucket_plan(windows: int, at_least: float, recall: float) -> tuple[int, int]:
    """(bits, tables): bits so that a bucket holds about 64 rows by chance, tables so that a pair at the threshold meets."""
    bits = max(2, math.ceil(math.log2(max(1, windows) / 64)))
    agree = 1 - math.acos(at_least) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def _frames(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=float)[: len(values) // BANDS * BANDS].reshape(-1, BANDS)


def scales(frames: int) -> list[int]:
    """Frames that an average takes: 1, 2, 4, ... as long as four averages fit."""
    return [1 << j for j in range(max(0, (frames // MIN_FRAMES).bit_length()))]


def windows(f: np.ndarray, scale: int, role: int) -> np.ndarray:
    """(windows, 64): four averages of `scale` frames each, from the offsets of the role on."""
    last = len(f) - MIN_FRAMES * scale
    starts = np.arange(0, last + 1, max(1, scale // 2)) if role == LONGER else np.unique(np.append(np.arange(0, last + 1, 2 * scale), last))
    sums = np.concatenate((np.zeros((1, BANDS)), np.cumsum(f, axis=0)))
    mean = (sums[scale:] - sums[:-scale]) / scale
    return mean[starts[:, None] + scale * np.arange(MIN_FRAMES)].reshape(len(starts), -1)


class _Signs:
    """Signs of random projections of centred vectors: bucket codes and a sketch.  Vectors of any length share the planes of their first entries."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.planes: list[np.ndarray] = []

    def __call__(self, w: np.ndarray, tables: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows that aren't flat, their codes in these tables, their sketches)."""
        w = w - w.mean(axis=1, keepdims=True)
        live = np.flatnonzero(np.linalg.norm(w, axis=1) > 0)
        while len(self.planes) * BANDS < w.shape[1]:
            drawn = np.random.default_rng([7, len(self.planes)]).standard_normal((BANDS, self.tables * self.bits + _SKETCH_BITS))
            self.planes.append(drawn.astype(np.float32))
        planes = np.concatenate(self.planes[: w.shape[1] // BANDS])
        side = lambda part: w[live].astype(np.float32) @ part > 0
        bits = side(planes[:, tables.start * self.bits : tables.stop * self.bits]).reshape(len(live), len(tables), self.bits)
        code = bits @ (1 << np.arange(self.bits, dtype=np.int64))
        return live, code, np.packbits(side(planes[:, self.tables * self.bits :]), axis=1).view(np.int64)


_SKETCH = tuple(f"s{i}" for i in range(_SKETCH_BITS // 64))
_BUCKETED = "kind int, t int, code long, role int, id long, frames int, " + ", ".join(f"{s} long" for s in _SKETCH)


def _bucketed(rows: DataFrame, whole: tuple[int, int], part: tuple[int, int] | None, shortest: int, longest: int, tables: range) -> DataFrame:
    """A row for each of `tables` of whole fingerprints (kind: minus their length) and, where lengths differ, of windows (kind: the scale)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_whole, of_part = _Signs(*whole), _Signs(*(part or whole))
        of = lambda signs: range(tables.start, min(tables.stop, signs.tables))

        def told(kind: int, role: int, ids: np.ndarray, frames: np.ndarray, vectors: np.ndarray, signs: _Signs) -> pd.DataFrame:
            own = of(signs)
            live, code, sketch = signs(vectors, own)
            again = lambda x: np.repeat(x[live], len(own))
            found = {"kind": kind, "t": np.tile(own, len(live)), "code": code.ravel(), "role": role, "id": again(ids), "frames": again(frames)}
            return pd.DataFrame(found | {s: np.repeat(sketch[:, i], len(own)) for i, s in enumerate(_SKETCH)})

        for pdf in batches:
            known = [(i, f) for i, f in zip(pdf["id"], map(_frames, pdf["f"]), strict=True) if len(f) >= MIN_FRAMES]
            for n in sorted({len(f) for _, f in known}):
                same = [(i, f) for i, f in known if len(f) == n]
                for at in range(0, len(same), 256):
                    ids, stack = np.array([i for i, _ in same[at : at + 256]]), np.stack([f for _, f in same[at : at + 256]])
                    if of(of_whole):
                        yield told(-n, WHOLE, ids, np.full(len(ids), n), stack.reshape(len(ids), -1), of_whole)
                    if part is None or not of(of_part):
                        continue
                    for scale in scales(n):
                        for role in (SHORTER, LONGER):
                            if n != (longest if role == SHORTER else shortest):
                                for few in range(0, len(ids), 32):
                                    own = [windows(f, scale, role) for f in stack[few : few + 32]]
                                    count = len(own[0])
                                    yield told(scale, role, np.repeat(ids[few : few + 32], count), np.full(len(own) * count, n), np.concatenate(own), of_part)

    return rows.mapInPandas(run, _BUCKETED)


def _meeting(buckets: DataFrame, at_least: float) -> DataFrame:
    """(a, b), a < b: recordings with rows that meet in a bucket with sketches close enough; a pair may be told by several buckets.

    buckets is made twice, for the sizes of its buckets and for the pairs, and
    shuffled once; what is shuffled for the sizes is one row per bucket and task.
    """
    share = math.acos(at_least) / math.pi
    bound = _SKETCH_BITS * share + 6 * math.sqrt(_SKETCH_BITS * share * (1 - share))
    bucket = ["kind", "t", "code"]

    def pairs_of(by_length: bool, across: bool, role: np.ndarray, ids: np.ndarray, frames: np.ndarray, block: np.ndarray, sketch: np.ndarray) -> Iterator[np.ndarray]:
        one, two = np.flatnonzero(role != LONGER), np.flatnonzero(role != SHORTER)
        for at in range(0, len(one), 64):
            x = one[at : at + 64, None]
            near = (np.bitwise_count(sketch[x] ^ sketch[two]).sum(axis=2) <= bound) & (ids[x] != ids[two])
            if by_length:
                near &= frames[two] > frames[x]
            if across:
                near &= block[x] != block[two]
            i, j = np.nonzero(near)
            if len(i):
                yield np.unique(np.sort(np.stack((ids[x[i, 0]], ids[two[j]]), axis=1), axis=1), axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in chain(batches, [None]):  # None: the end
            rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            keys = rows[[*bucket, "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = np.append(cut, len(rows)) if pdf is None else cut
            sketch = np.ascontiguousarray(rows[[*_SKETCH]].to_numpy()).view(np.uint64)
            columns = [*(rows[c].to_numpy() for c in ("role", "id", "frames", "block")), sketch]
            found = [np.empty((0, 2), np.int64)]
            for first, end in zip(np.append(0, cut[:-1]), cut, strict=True) if len(cut) else ():
                if end - first > 1:
                    found += pairs_of(keys[first, 0] > 0, keys[first, 3] != keys[first, 4], *(c[first:end] for c in columns))
            yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
            held = rows.iloc[cut[-1] :].reset_index(drop=True) if len(cut) else rows

    large = small(settled(buckets.groupBy(*bucket).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)))  # fewer than a 512th of the rows
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    cut = buckets.join(large, bucket, "left").withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id", *_SKETCH), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = cut.select(*bucket, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "role", "id", "frames", *_SKETCH)
    unit = [*bucket, "lo", "hi"]
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(run, "a long, b long")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting holds for the actions run meanwhile."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length of a batch (id, n, f): its recordings as bytes, without those that hold null or non-finite values."""
    for batch in batches:
        n, ids = batch.column("n").to_numpy(), batch.column("id").to_numpy()
        for frames in np.unique(n):
            at = np.flatnonzero(n == frames)
            f = batch.column("f").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            sound = np.isfinite(f).all(axis=1)
            if sound.any():
                yield pa.RecordBatch.from_arrays([pa.array([frames], pa.int32()), pa.array([ids[at][sound].tobytes()]), pa.array([f[sound].tobytes()])], names=["n", "ids", "f"])


def _centred(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = w - w.mean(axis=1, keepdims=True)
    return w, np.linalg.norm(w, axis=1)


def best_earlier(short: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray] | None, at_least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, score, partner): of the recordings of two blocks with a partner of a smaller id in the other one, the best; of equal scores (nine digits) the smallest id.

    A block is (ids, values), recordings of one length; short's are no longer than
    other's; no other: short with itself.  Single precision finds the pairs that
    can be the best of a recording, within the error that it can have at most;
    these are scored in double precision.
    """
    (ids, x), (other_ids, y) = short, other or short
    size = x.shape[1]
    slack = (size + 8) * 2.0**-24
    limit = np.float32(at_least - slack)
    places = range(0, y.shape[1] - size + 1, BANDS)

    def units(w: np.ndarray) -> np.ndarray:
        w, norm = _centred(w)
        return np.divide(w, norm[:, None], out=np.zeros_like(w), where=norm[:, None] > 0).astype(np.float32)

    def settle(known: list[np.ndarray], found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        i, j, place, near = (np.concatenate(c) for c in zip(*found, strict=True))
        apart = ids[i] != other_ids[j]
        i, j, place, near = i[apart], j[apart], place[apart], near[apart]
        b = np.maximum(ids[i], other_ids[j])
        own, back = np.unique(b, return_inverse=True)
        top = np.full(len(own), -np.inf, np.float32)
        np.maximum.at(top, back, near)
        able = np.flatnonzero(near >= top[back] - 2 * slack)
        score = np.empty(len(able))
        for at in range(0, len(able), 8192):
            few = able[at : at + 8192]
            s, s_norm = _centred(x[i[few]])
            w, w_norm = _centred(y[j[few, None], place[few, None] + np.arange(size)])
            score[at : at + 8192] = np.einsum("ij,ij->i", s, w) / (s_norm * w_norm)
        able, score = able[score >= at_least], score[score >= at_least]
        mine = [b[able], score, np.minimum(ids[i[able]], other_ids[j[able]])]
        b, score, a = (np.concatenate(c) for c in zip(known, mine, strict=True))
        order = np.lexsort((a, -np.round(score, 9), b))
        own, first = np.unique(b[order], return_index=True)
        return [own, np.maximum.reduceat(score[order], first) if len(own) else score, a[order[first]]]

    best, found, held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)], [], 0
    of_short = units(x)
    for place in places:
        of_other = of_short if other is None else units(y[:, place : place + size])
        for i in range(0, len(x), BLOCK):
            for j in range(i // 1024 * 1024 if other is None else 0, len(y), 1024):
                near = of_short[i : i + BLOCK] @ of_other[j : j + 1024].T
                hit = np.flatnonzero(near.ravel() >= limit)
                if len(hit):
                    row, column = np.divmod(hit, near.shape[1])
                    found.append((i + row, j + column, np.full(len(hit), place), near.ravel()[hit]))
                    held += len(hit)
                    if held > 1_000_000:
                        best, found, held = settle(best, found), [], 0
    return tuple(settle(best, found) if found else best)


def _best(scored: DataFrame) -> DataFrame:
    """(b, score, a) of the highest score of each b; of equal ones (nine digits) the smallest a."""
    best = scored.groupBy("b").agg(F.max("score").alias("score"), F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("a")).alias("a"))).alias("m"))
    return best.select("b", "score", (-F.col("m.a")).alias("a"))


def _best_of_all(texts: DataFrame, rows: int, at_least: float) -> DataFrame:
    """(b, score, a): the best earlier partner a of every recording b, all pairs compared at all alignments.

    A pair of blocks is one row, and one batch, of a join without keys: Spark deals
    pairs of partitions to tasks, and of blocks neither shuffles nor sends any.
    """
    spark = texts.sparkSession
    n = F.floor(F.size("f") / BANDS).cast("int")
    known = texts.select("id", n.alias("n"), F.slice("f", F.lit(1), n * BANDS).alias("f")).filter(F.col("n") >= MIN_FRAMES)
    near = known.repartitionByRange(max(1, math.ceil(rows / RECORDINGS)), "n", F.xxhash64("id"))
    blocks = settled(near.mapInArrow(_packed, "n int, ids binary, f binary").withColumn("block", F.monotonically_increasing_id())).coalesce(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                of = lambda name: batch.column(name)[r]  # noqa: B023, E731
                sides = []
                for side in "xy":
                    ids = np.frombuffer(of(f"{side}_ids").as_buffer(), np.int64)
                    sides.append((ids, np.frombuffer(of(f"{side}_f").as_buffer(), np.float64).reshape(len(ids), -1)))
                same = of("x_block").as_py() == of("y_block").as_py()
                short, other = sorted(sides, key=lambda side: side[1].shape[1])
                b, score, a = best_earlier(short, None if same else other, at_least)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(score), pa.array(a)], names=["b", "score", "a"])

    x, y = (blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in ("block", "ids", "f"))) for side in "xy")
    one, two = F.col("x_block"), F.col("y_block")
    turn = F.pmod(F.xxhash64(F.least(one, two), F.greatest(one, two)), F.lit(2)) == 0  # which side of the diagonal has the pair
    pairs = x.join(y.hint("shuffle_replicate_nl"), (one == two) | ((one != two) & ((one < two) == turn)))
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        return settled(_best(pairs.mapInArrow(run, "b long, score double, a long")))


def _best_in_buckets(texts: DataFrame, at_least: float, recall: float) -> DataFrame:
    """(b, score, a): the best earlier partner a of every recording b among those that meet in a bucket."""
    n = F.floor(F.size("f") / BANDS)
    lengths = texts.filter(n >= MIN_FRAMES).groupBy(n.alias("n")).agg(F.count("*").alias("c"))
    most, offsets, shortest, longest = lengths.agg(F.max("c"), F.sum(F.col("c") * (F.col("n") - MIN_FRAMES + 1)), F.min("n"), F.max("n")).first()
    part = bucket_plan(offsets, at_least, recall) if shortest != longest else None
    whole = bucket_plan(most or 0, at_least, recall)
    last = max(whole[1], part[1] if part else 0)
    pairs = [settled(_meeting(_bucketed(texts, whole, part, shortest, longest, range(t, min(t + TABLES, last))), at_least).distinct()) for t in range(0, last, TABLES)]
    pairs = settled(reduce(DataFrame.unionByName, pairs).distinct())

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = [best_correlation(_frames(x), _frames(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            found = pdf[["a", "b"]].assign(score=score)
            yield found[found["score"] >= at_least]

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("f").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("f").alias("y")), "b")
    return _best(both.select("a", "b", "x", "y").mapInPandas(verify, "a long, b long, score double"))


def near_duplicates(rows: DataFrame, key: str, fingerprint: str, digest: str, at_least: float = 0.9, recall: float = 0.999) -> DataFrame:
    """(key, near_duplicate_of, score): the original of the best earlier recording with another content and correlation >= at_least.

    Earlier is a smaller key; of equal scores (nine digits) the smallest key
    counts.  near_duplicate_of is that recording's own original, so it never
    points at a copy of a copy.  Of recordings with one digest the first alone is
    compared.  Fingerprints under four frames, flat ones, null keys and null
    fingerprints have no partner.  Pairs of equal length at the threshold are
    found with the chance `recall`, more alike ones more surely; so are pairs of
    unequal length of which a window at some scale (see the module) is that alike.
    With a recall of 1 all pairs are compared.
    """
    with _set(rows.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # shuffle files are dropped as each action ends
        named = rows.select(F.col(key).cast("long").alias("id"), F.col(fingerprint).alias("f"), F.col(digest).alias("d")).filter("id IS NOT NULL AND f IS NOT NULL")
        first = settled(named.groupBy("d").agg(F.min("id").alias("id")))
        texts = settled(named.join(first, ["d", "id"], "left_semi").dropDuplicates(["id"]).select("id", "f"))
        best = _best_of_all(texts, texts.count(), at_least) if recall >= 1 else _best_in_buckets(texts, at_least, recall)
        links = settled(best.select(F.col("b").alias("id"), F.col("a").alias("to"), "score"))
        while True:  # each round halves the way to the original
            up = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
            moved = settled(links.join(up, "to", "left").select("id", F.coalesce("next", "to").alias("to"), "score", F.col("next").isNotNull().alias("moved")))
            done = moved.filter("moved").isEmpty()
            links = moved.drop("moved")
            if done:
                return links.select(F.col("id").alias(key), F.col("to").alias("near_duplicate_of"), "score")


_PLAIN = """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_concat(list_concat(e, h), list_transform(e, lambda x, i: x * ((i - 1) % 5 - 2))) ELSE list_concat(e, h) END AS f
    FROM (SELECT vec_id, e, list_transform(list_reverse(e), lambda x, i: 0.5 * x + ((i - 1) // 16) * 0.05) AS h FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))"""
_SOUNDS = f"""SELECT vec_id, f FROM ({_PLAIN}) UNION ALL
    SELECT vec_id + 1000000000, list_transform(f, lambda x, i: x * (1 + ((i - 1) % 3) * 0.3)) FROM ({_PLAIN}) WHERE vec_id % 4 = 0 UNION ALL
    SELECT vec_id + 2000000000, list_transform(f, lambda x, i: x * (1 + ((i - 1) % 3) * 0.6)) FROM ({_PLAIN}) WHERE vec_id % 4 = 1 UNION ALL
    SELECT vec_id + 3000000000, f FROM ({_PLAIN}) WHERE vec_id % 8 = 0 UNION ALL
    SELECT vec_id + 4000000000, f[33:] FROM ({_PLAIN}) WHERE vec_id % 4 = 2 UNION ALL
    SELECT vec_id + 5000000000, list_transform(f[17:112], lambda x, i: x * (1 + ((i - 1) % 2) * 0.3)) FROM ({_PLAIN}) WHERE vec_id % 4 = 3"""
_CENTRED = "list_transform({0}, lambda x: x - list_avg({0}))"


@query(
    "j5_near_duplicates",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT min(vec_id) AS id, f FROM ({_SOUNDS}) GROUP BY f),
    cut AS MATERIALIZED (SELECT id, len(f) AS whole, n, o, {_CENTRED.format("w")} AS u FROM (SELECT id, f, n, o, f[o * 16 + 1 : o * 16 + n] AS w FROM (
        SELECT id, f, n, unnest(range(0, (len(f) - n) // 16 + 1)) AS o FROM s JOIN (SELECT DISTINCT len(f) AS n FROM s) ON n <= len(f)))),
    p AS (SELECT greatest(a.id, b.id) AS id, least(a.id, b.id) AS other, max(list_cosine_similarity(a.u, b.u)) AS score FROM cut a JOIN cut b ON a.n = a.whole AND b.n = a.n AND (b.whole > a.whole OR (b.whole = a.whole AND a.id < b.id)) GROUP BY ALL),
    best AS (SELECT id, arg_max(other, (round(score, 9), -other)) AS up, max(score) AS score FROM p WHERE score >= 0.9 GROUP BY id),
    chain AS (SELECT id, up FROM best UNION ALL SELECT c.id, b.up FROM chain c JOIN best b ON b.id = c.up)
    SELECT b.id AS vec_id, (SELECT min(up) FROM chain WHERE chain.id = b.id) AS near_duplicate_of, round(score, 6) AS score FROM best b""",
)
def _j5(v: Views) -> DataFrame:
    """Fingerprints of 6 to 12 frames made of the embeddings, with copies, changed and trimmed copies and exact repeats beside them."""
    e = F.col("embedding").cast("array<double>")
    faded = F.transform(F.reverse(e), lambda x, i: x * 0.5 + F.floor(i / 16) * 0.05)
    turned = F.transform(e, lambda x, i: x * (i % 5 - 2))
    plain = v.embeddings.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.concat(e, faded, turned)).otherwise(F.concat(e, faded)).alias("f"))

    def beside(rest: int, move: int, f: Column, every: int = 4) -> DataFrame:
        return plain.filter(F.col("vec_id") % every == rest).select((F.col("vec_id") + move * 1_000_000_000).alias("vec_id"), f.alias("f"))

    waved = lambda f, of, by: F.transform(f, lambda x, i: x * (1 + (i % of) * by))
    rows = plain
    for more in (
        beside(0, 1, waved("f", 3, 0.3)), beside(1, 2, waved("f", 3, 0.6)), beside(0, 3, F.col("f"), 8),
        beside(2, 4, F.slice("f", 33, 1_000)), beside(3, 5, waved(F.slice("f", 17, 96), 2, 0.3)),
    ):
        rows = rows.unionByName(more)
    found = near_duplicates(rows.withColumn("digest", F.md5(F.to_json("f"))), "vec_id", "f", "digest", recall=1.0)
    return found.withColumn("score", F.round("score", 6))
