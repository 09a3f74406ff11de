"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word n-grams.  Two documents link when
100 * |A & B| >= percent * |A | B|, that is when the symmetric difference holds
at most (100 - percent) / (100 + percent) * (|A| + |B|) shingles.  PartEnum cuts
the feature domain into partitions: if at most k shingles differ, then at most k
partitions are touched, so of the first k + 1 partitions, in any order that both
sets use, one is the same in both.  Each set emits one signature for each subset
of that enumeration (the level-two subset is the whole partition, the point of
the parameter space with the fewest signatures), and linked sets share one.
Partitions that hold nothing but shingles of very many documents come last in the
order, so a passage that much of a corpus shares makes no signature while a set
has others.  Sizes are cut in bands of a fixed ratio with their own number of
partitions; a set just below the next band also signs in that band.

Groups of equal signatures are never expanded to all pairs: each member is tried
against one pivot, the links found are contracted to components, and only
members of groups (all signatures with one pivot) that still hold several
components are compared further, inside tasks, in blocks, by parity sketches whose distance never exceeds the
real one.  What a sketch cannot exclude is checked on the exact sets.  First each
member proposes its nearest one in another component alone, and what links is
contracted; all pairs of what is still apart are compared last, so a large group
of near copies isn't expanded to the pairs between its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auralake.llm.components import connected_components
from auralake.llm.hashing import U64, mix, shingle_set
from auralake.llm.storage import TEXT_BATCH, discard, filter_by_ids, id_long, id_text, join_hot_apart, materialise

#: Upper size of a band over its lower size.
BAND_RATIO = 4
#: Sizes below this sign every shingle as a partition of its own.
SINGLE_BELOW = 64
#: Bits a shingle of the sketch that goes with every group member, and of the one for single pairs.
COARSE, FINE = 2, 6
#: Rows of a signature group that are compared with each other in one piece.
BLOCK = 512
#: A shingle is told as frequent by a batch of texts if this share of them holds it (and at least four do).
OFTEN = 0.02


def _bands() -> list[int]:
    return [BAND_RATIO**i for i in range(24)]


def signatures(shingles: np.ndarray, percent: int, often: np.ndarray | None = None) -> np.ndarray:
    """Signatures of one sorted shingle set (see the module text); often: the sorted frequent shingles."""
    n = len(shingles)
    if not n:
        return np.empty(0, dtype=U64)
    common = np.zeros(n, dtype=bool)
    if often is not None and len(often):
        at = np.searchsorted(often, shingles)
        common = often[np.minimum(at, len(often) - 1)] == shingles
    lows = _bands()
    band = int(np.searchsorted(lows, n, side="right")) - 1
    out = []
    for b in (band, band + 1):
        low, high = lows[b], lows[b + 1] - 1
        if b > band and n * 100 < low * percent:
            continue  # no partner in the next band
        most = min(n * 100 // percent, high)
        k = (100 - percent) * (n + most) // (100 + percent)
        parts = 2**32 if high < SINGLE_BELOW else max(1, int(0.35 * high))
        part = ((shingles >> U64(32)) * U64(parts)) >> U64(32)
        start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        inside = np.add.reduceat(mix(shingles), start)
        last = np.logical_and.reduceat(common, start)  # known from the partition's content alone
        chosen = np.argsort(last, kind="stable")[: k + 1] if last.any() else slice(0, k + 1)
        out.append(mix(inside[chosen] + part[start[chosen]] * U64(0x9E3779B97F4A7C15) + U64(b + 1)))
    return np.concatenate(out)


def parity_sketch(shingles: np.ndarray, bits_each: int) -> bytes:
    """Bit i is the parity of the shingles that fall on i; bits_each to twice as many bits a shingle.

    A shingle in one of two sets only flips one bit, so the sketches differ in
    no more bits than the sets in shingles.  Widths are powers of two, and a
    sketch folds to half its width by XOR.
    """
    bits = 1 << max(6, int(bits_each * max(1, len(shingles)) - 1).bit_length())
    at = (mix(shingles ^ U64(0x5DEECE66D)) & U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _fold(sketch: np.ndarray, width: int) -> np.ndarray:
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, dtype=U64), np.frombuffer(b, dtype=U64)
    width = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, width) ^ _fold(y, width)).sum())


def describe_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, text_key, n_shingles, digest, sketch, fine, often) of every row; empty sets have a null digest.

    often, on the first row of each batch of texts, lists the shingles that are frequent there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "node": pdf["node"],
                    "text_key": pdf["text_key"],
                    "n_shingles": [len(s) for s in sets],
                    "digest": [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "sketch": [parity_sketch(s, COARSE) if len(s) else None for s in sets],
                    "fine": [parity_sketch(s, FINE) if len(s) else None for s in sets],
                    "often": [_often(sets), *[None] * (len(sets) - 1)] if len(sets) else [],
                }
            )

    rows = docs.select(id_text(id_col, "node"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(run, "node string, text_key long, n_shingles long, digest binary, sketch binary, fine binary, often array<long>")
    return id_long(found, "node")


def _often(sets: list[np.ndarray]) -> np.ndarray:
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    return found[n >= max(4, OFTEN * len(sets))].view(np.int64)


def frequent_shingles(sets: DataFrame, most: int = 1_000_000) -> np.ndarray:
    """Sorted shingles that batches of all texts tell as frequent, those of most batches first, `most` at the most.

    They only order partitions, so any list gives the same links; a longer one makes fewer signatures meet by chance.
    """
    told = sets.filter("often IS NOT NULL").select(F.explode("often").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    rows = told.orderBy(F.desc("n"), "s").limit(most).select("s").toPandas()
    return np.sort(rows["s"].to_numpy(dtype=np.int64).view(U64))


def _signature_rows(texts: DataFrame, words: int, percent: int, often: np.ndarray) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(often)  # at most eight megabytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), 256):
                nodes, sizes, found = [], [], []
                for node, text in zip(pdf["node"][first : first + 256], pdf["text"][first : first + 256], strict=True):
                    s = shingle_set(text, words)
                    g = signatures(s, percent, shared.value)
                    nodes.append(np.full(len(g), node, dtype=np.int64))
                    sizes.append(np.full(len(g), len(s), dtype=np.int32))
                    found.append(g)
                yield pd.DataFrame(
                    {
                        "sig": np.concatenate(found).view(np.int64),
                        "node": np.concatenate(nodes),
                        "n": np.concatenate(sizes),
                    }
                )

    return texts.mapInPandas(run, "sig long, node long, n int")


def _set_rows(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame(
                {"node": pdf["node"], "items": [shingle_set(t, words).tobytes() for t in pdf["text"]]}
            )

    return texts.mapInPandas(run, "node long, items binary")


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [
                _sketch_distance(x, y) * (100 + percent) <= (100 - percent) * (m + n)
                for x, y, m, n in zip(pdf["sa"], pdf["sb"], pdf["na"], pdf["nb"], strict=True)
            ]
            yield pdf.loc[keep, ["a", "b"]]

    one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    two = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long")


def _narrowed(pairs: DataFrame, coarse: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """Pairs that neither sketch excludes, materialised."""
    near = materialise(_close(pairs, coarse, percent).distinct(), "near", TEXT_BATCH)
    return materialise(_close(near, fine, percent).distinct(), "close", TEXT_BATCH)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link, by exact intersection; pairs is a materialised table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(_set_rows(filter_by_ids(texts, materialise(ids, "ids"), "node"), words), "sets", TEXT_BATCH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                p, q = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pdf.loc[keep, ["a", "b"]]

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    links = materialise(pairs.join(one, "a").join(two, "b").mapInPandas(run, "a long, b long").distinct(), "links", TEXT_BATCH)
    discard(sets)
    return links


def _compare_unit(unit: pd.DataFrame, percent: int, nearest: bool) -> Iterator[tuple[int, int, float]]:
    """Pairs of one block unit in different components that sketches allow, with their distance; rows come sorted by n.

    A pair is told in the first group that holds both nodes and in no other;
    nearest: each node with the nearest other one of the unit instead.
    """
    key = unit["key"].iat[0]
    node, comp = unit["node"].to_numpy(), unit["component"].to_numpy()
    n, block = unit["n_shingles"].to_numpy(), unit["block"].to_numpy()
    cross = unit["lo"].iat[0] != unit["hi"].iat[0]
    if not cross and (comp == comp[0]).all():
        return
    groups = [set(g) for g in unit["groups"]]
    words = [np.frombuffer(s, dtype=U64) for s in unit["sketch"]]
    widths = np.array([len(w) for w in words])
    table = {w: np.stack([_fold(words[i], w) for i in np.flatnonzero(widths >= w)]) for w in np.unique(widths)}
    rank = {w: np.cumsum(widths >= w) - 1 for w in table}
    last = np.searchsorted(n, n * 100 // percent, side="right")
    best, other = np.full(len(node), np.inf), np.arange(len(node))
    for i in range(len(node) - 1):
        later = np.arange(i + 1, last[i])
        later = later[comp[later] != comp[i]]
        if cross:
            later = later[block[later] != block[i]]
        for w in np.unique(np.minimum(widths[later], widths[i])) if len(later) else ():
            some = later[np.minimum(widths[later], widths[i]) == w]
            gap = np.bitwise_count(table[w][rank[w][some]] ^ table[w][rank[w][i]]).sum(axis=1, dtype=np.int64)
            allowed = gap * (100 + percent) <= (100 - percent) * (n[some] + n[i])
            some, far = some[allowed], (gap / (n[some] + n[i]))[allowed]
            if not nearest:
                for j, d in zip(some, far, strict=True):
                    if min(groups[i] & groups[j]) == key:
                        yield int(min(node[i], node[j])), int(max(node[i], node[j])), float(d)
                continue
            closer = far < best[some]
            best[some[closer]], other[some[closer]] = far[closer], i
            if len(far) and far.min() < best[i]:
                best[i], other[i] = far.min(), some[far.argmin()]
    if nearest:
        for i in np.flatnonzero(best < np.inf):
            yield int(node[i]), int(node[other[i]]), float(best[i])


def _block_pairs(rows: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Candidate pairs of the groups in rows (key, size, node, component, n_shingles, sketch, groups).

    groups: the keys of all groups in rows that hold the node.  nearest: at most
    one pair for each node, that with the nearest node in another component.

    A group of up to BLOCK rows is one unit; a larger one is dealt to blocks by
    a hash of the node, and every two blocks make a unit.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            unit = pdf[["key", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
            for first, end in zip(np.concatenate(([0], cut[:-1])), cut, strict=True) if len(cut) else ():
                found = list(_compare_unit(pdf.iloc[first:end], percent, nearest))
                if found:
                    yield pd.DataFrame(found, columns=["a", "b", "far"])
            held = pdf.iloc[cut[-1] :].reset_index(drop=True) if len(cut) else pdf
        if held is not None and len(held):
            found = list(_compare_unit(held, percent, nearest))
            if found:
                yield pd.DataFrame(found, columns=["a", "b", "far"])

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    units = (
        rows.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
        .select("key", "lo", "hi", "block", "node", "component", "n_shingles", "sketch", "groups")
    )
    found = (
        units.repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi", "n_shingles")
        .mapInPandas(run, "a long, b long, far double")
    )
    if nearest:
        found = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
    return found.select("a", "b").distinct()


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75
) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs.

    component_id is the smallest id reachable over links, the row's own included.
    Null or wordless texts have 0 shingles and link with nothing; fewer words
    than `words` make one shingle of the whole sequence.  Equal sets always link.
    Rows that repeat an id count as one document with several texts, each of
    which links by itself.  A row with
    a null id gets a null component.  Other columns are ignored; an empty table
    gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    sets = materialise(describe_sets(docs, id_col, text_col, words), "sets", TEXT_BATCH)
    usable = sets.filter("digest IS NOT NULL AND node IS NOT NULL")
    narrow = usable.select("node", "text_key", "digest")
    classes = narrow.groupBy("digest").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1")
    narrow = join_hot_apart(narrow, materialise(classes, "classes"), "digest", sets.count())
    copies = materialise(narrow.filter("node <> first").select("node", "text_key", "first").distinct(), "copies")
    groups = _signature_groups(texts, sets, copies, words, percent)
    coarse = usable.select("node", "n_shingles", "sketch")
    fine = usable.select("node", "n_shingles", F.col("fine").alias("sketch"))

    star = groups.filter("node <> pivot AND 100 * least(n, pn) >= %d * greatest(n, pn)" % percent)
    star = star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = _verified(_narrowed(star, coarse, fine, percent), texts, words, percent)

    for nearest in (True, False):  # what the nearest neighbours link needs no pair by pair comparison
        mixed = _mixed(groups, connected_components(links))
        if mixed.isEmpty():
            break
        held_by = mixed.groupBy("node").agg(F.collect_set("key").alias("groups"))  # no more than a set has signatures
        rows = mixed.join(coarse.join(held_by, "node"), "node")
        near = materialise(_block_pairs(rows, percent, nearest), "near", TEXT_BATCH)
        rest = materialise(_close(near, fine, percent).distinct(), "close", TEXT_BATCH)
        links = links.unionByName(_verified(rest, texts, words, percent))
        discard(mixed)
    links = links.unionByName(copies.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    final = connected_components(links)
    return (
        sets.select("node", "n_shingles")
        .join(final, "node", "left")
        .select(F.col("node").alias("doc_id"), "n_shingles", F.coalesce("component", "node").alias("component_id"))
    )


def _mixed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(key, size, node, component) of the members of groups that hold several components."""
    w = Window.partitionBy("pivot")
    rows = groups.filter("several").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = (
        rows.withColumn("low", F.min("component").over(w))
        .withColumn("high", F.max("component").over(w))
        .withColumn("size", F.count("*").over(w))
        .filter("low <> high")
        .select(F.col("pivot").alias("key"), "size", "node", "component")
    )
    return materialise(rows, "mixed")


def _signature_groups(texts: DataFrame, sets: DataFrame, copies: DataFrame, words: int, percent: int) -> DataFrame:
    """Members of the signatures that several sets share, by pivot: (node, n, pivot, pn, several).

    The pivot of a signature is its smallest node.  Signatures with one pivot
    make one group, in which each member stands once: two sets that share a
    signature share its pivot.  several: a signature of three sets or more.
    """
    firsts = filter_by_ids(texts.filter("node IS NOT NULL"), copies.select("node", "text_key"), ["node", "text_key"], "left_anti")
    w = Window.partitionBy("sig")
    grouped = (
        _signature_rows(firsts, words, percent, frequent_shingles(sets))
        .withColumn("size", F.count("*").over(w))
        .withColumn("top", F.min(F.struct("node", "n")).over(w))
        .filter("size > 1")
        .select("node", "n", F.col("top.node").alias("pivot"), F.col("top.n").alias("pn"), (F.col("size") > 2).alias("several"))
    )
    return materialise(grouped.groupBy("node", "n", "pivot", "pn").agg(F.max("several").alias("several")), "groups", TEXT_BATCH)
