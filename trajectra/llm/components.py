"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of the links (a, b), two longs; ``component`` is the least node reachable.

    A large star links every greater neighbour of a node with the node's least neighbour, a small
    star the lesser ones; the links shrink to stars around the least nodes in a number of rounds
    that grows with the logarithm of the nodes. Least neighbours are reduced before the shuffle,
    and the joins that follow have one row per node on one side, so that a node with very many
    links is split over tasks. Each round is a written table.

    Links that repeat, in either direction, and of a node with itself make no difference; an empty
    table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        shrunk = materialize(small, "small-star")
        discard(edges, large)
        edges = shrunk
        last, state = state, _state(edges)
        if last == state:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
