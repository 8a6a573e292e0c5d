"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a pre-aggregated minimum per node and an equi-join. The minima are written first: few are
broadcast; else the join reads plain shuffles, of which Spark splits that of a node with many links (one
that also aggregates, it can't). Edges stay distributed; each round is written to the shared folder, which
cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_side


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large star hangs each larger neighbour of a node on the node's
    smallest neighbour; small star hangs the node and its smaller neighbours on that. The result is written."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        new = both.filter("v > u").join(small_side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = edges.join(small_side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = near.unionByName(least.select("u", F.col("m").alias("v")))
    out = materialise(new.filter("u > v").distinct(), "edges")
    discard(least, edges)
    return out


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: two columns of comparable ids. Returns (node, root): root is the smallest id reachable.

    Ids without a link are not returned. Self links, repeated links and null ends are ignored.
    An empty input gives an empty result.
    """
    a, b = links.columns[:2]
    edges = materialise(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("a"), F.col(b).alias("b"))
        .filter("a is not null and b is not null and u > v").select("u", "v").distinct(),
        "edges",
    )
    before = _signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = _star(_star(edges, True), False)
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return root.unionByName(own)
