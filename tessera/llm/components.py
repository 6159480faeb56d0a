"""Connected components of a table of links, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint


def _hook(links: DataFrame, smaller_only: bool) -> DataFrame:
    """Link every neighbour of a vertex to the smallest of its neighbours and itself.

    ``links`` has a > b. With ``smaller_only`` a vertex sees its smaller neighbours (small star), else its
    neighbours on both sides, of which it moves the larger ones (large star). The minimum is a partial
    aggregate and the join is plain, so a vertex with very many neighbours is no single task."""
    seen = links.select(F.col("a").alias("v"), F.col("b").alias("w"))
    if not smaller_only:
        seen = seen.unionAll(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
    least = seen.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
    if smaller_only:
        moved = seen.join(least, "v").select(F.explode(F.array("v", "w")).alias("a"), F.col("m").alias("b"))
    else:
        moved = seen.where("w > v").join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, root) of every vertex in ``links`` (a, b: two linked vertices); root is the smallest reachable.

    Null vertices and loops are left out. Each round is one large and one small star; it ends when a round
    changes nothing, which takes about the logarithm of the longest path."""
    now = links.where("a is not null and b is not null and a <> b")
    now = checkpoint(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = None
    for _ in range(max_rounds):
        now = checkpoint(_hook(_hook(now, False), True))
        was, sign = sign, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == was:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    raise RuntimeError(f"links are not settled after {max_rounds} rounds")
