"""Connected components of an edge list, by alternating star contractions on Spark.

Each round of the large star links the larger neighbours of a node to the smallest node of its neighbourhood, each
round of the small star links the smaller ones to it; when nothing changes, every node is linked to the smallest node
of its component. Rounds grow with the logarithm of the longest path. Minima are taken with partial sums and go back to the edges by a join
that deals the neighbours of a node to ``SALTS`` parts, so that a hub's edges are never gathered in one task. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galerna.llm.common import drop_table, materialize, spread_join

MAX_ROUNDS = 60
#: Parts of the neighbours of a node.
SALTS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).head())


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m) for each edge, m the least v of u."""
    return spread_join(edges, edges.groupBy("u").agg(F.min("v").alias("m")), "u", "v", SALTS)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    # the least neighbour's own edge is the node's: it goes to (u, m), all others to (v, m)
    return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v: long); component is the smallest node reachable.

    Loops and repeated edges do no harm; nodes without an edge to another node do not appear. An empty edge list
    gives no rows.
    """
    edges = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        moved = _small_star(_large_star(edges)).filter("u <> v").distinct()
        done, edges = edges, materialize(moved, "edges")
        drop_table(done)
        was, state = state, _state(edges)
        if was == state:
            break
    else:
        raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
