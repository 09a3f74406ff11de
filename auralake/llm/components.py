"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.storage import discard, join_hot_apart, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is its smallest node.

    Every round hangs neighbours on the smallest neighbour by a grouped minimum
    and an equi-join, so no neighbour list is gathered in one place; the edges of
    a node with very many neighbours are joined without being shuffled by it.  An empty
    edge table gives an empty result; loops and repeated edges change nothing.
    """
    pairs = materialise(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        larger = both.filter("v > u")  # a node with very many neighbours keeps them where they are
        large = join_hot_apart(larger, materialise(least, "least"), "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
        )
        after = materialise(small.filter("u <> v").distinct(), "edges")
        new = _state(after)
        discard(pairs)
        pairs, done, state = after, new == state, new
        if done:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(pairs: DataFrame) -> tuple[int, str]:
    row = pairs.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], str(row["h"])
