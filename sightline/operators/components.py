"""Connected components by alternating large-star and small-star rounds.

Each round is a group-by minimum, combined map-side, and an equi-join with one row a node on one
side.  The edges of a hub meet that row in one partition, which streams and is split where it is
large (adaptive skew joins); they are never a group in memory.  Rounds are written to shared storage; their number is logarithmic in the
longest path.  Nodes may be of any orderable type; the label of a component is its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.plans.store import materialize, settled, shuffled


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(shuffled(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; nodes without edges do not appear.

    Null ends and self loops are dropped.  Raises if ``max_rounds`` do not reach the fixpoint.
    """
    return settled(edges.sparkSession, "components", lambda: _components(edges, src, dst, max_rounds))


def _components(edges: DataFrame, src: str, dst: str, max_rounds: int) -> DataFrame:
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    now = materialize(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = materialize(_small_star(_large_star(now)).distinct(), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
