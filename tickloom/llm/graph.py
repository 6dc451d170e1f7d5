"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced, settled

#: Steps double the reach at least every few rounds; this many are never needed.
MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches), for the nodes of the edges a, b.

    Minima are aggregated before they are joined back, so a node with very many
    edges is summed up where its edges are, and AQE can split its join.
    """
    now = settled(_tidy(edges.select("a", "b")))
    size = _size(now)
    for _ in range(MOST_ROUNDS):
        now = replaced(_small(_large(now)), now)
        before, size = size, _size(now)
        if size == before:
            break
    else:
        raise RuntimeError("components don't settle")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, with a > b."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _size(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to its smallest one (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
    return _tidy(up.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small(edges: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(down.unionByName(least.select("a", F.col("m").alias("b"))))
