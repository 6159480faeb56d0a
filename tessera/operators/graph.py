"""Best paths from seeds through typed edges, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import confidence_weight, extractor_weight
from tessera.operators.joins import meet, present
from tessera.operators.lineage import checkpoint

# Relations that are walked by default, and the weak one that is walked on demand.
WALKED = "CONTAINS DEFINES DOC_EXPLAINS DOC_MENTIONS IMPLEMENTS IMPORTS QUERY_TOUCHES_TABLE REFERENCES ROUTE_TO_HANDLER SB_DEFINES_REQUIREMENT SB_DEFINES_VALIDATION SB_REFERENCES_API SB_REFERENCES_STATUS".split()
WEAK = "SEMANTIC_CANDIDATE"


def edge_weight() -> Column:
    """What an edge adds to the weight of a path."""
    weak = F.when(F.col("relation") == WEAK, -20.0).otherwise(0.0)
    return confidence_weight("confidence") / 4.0 + extractor_weight("extractor") / 3.0 + weak


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 3, include_weak: bool = False, relations: list[str] | None = None) -> DataFrame:
    """id, distance, weight and relations of the best path to every node within ``max_depth`` edges of a seed.

    With a column task_id in ``seeds`` every task walks on its own, all in the same joins. Edges are walked both ways between nodes of ``nodes`` (id); they
    are written once, as lists of what a node leads to, and those of hubs are dealt over tasks. The nearest path is best, then the heaviest, then
    the one with the heaviest last edge, then by relation and ends. Each level is one join of the frontier and one
    anti join with what was reached before; of the paths to a node only the best goes on. Whether a node is one of ``nodes`` is asked of
    the best path alone, so edges, which are many and wide, are not sorted for it; ``nodes`` are read at each level."""
    task = [c for c in ("task_id",) if c in seeds.columns]
    key = [*task, "id"]
    allowed = list(relations or WALKED) + [WEAK] * include_weak
    walked = edges.where(F.col("relation").isin(allowed)).select("src", "dst", "relation", edge_weight().alias("w"), (edge_weight() + F.coalesce("score", F.lit(0.0))).alias("pull"))
    both = walked.select(F.col("src").alias("a"), F.col("dst").alias("b"), "*").unionAll(walked.select(F.col("dst").alias("a"), F.col("src").alias("b"), "*"))
    both = checkpoint(both.select("a", "b", "src", "dst", "relation", "w", "pull"))
    start = present(checkpoint(seeds.select(*key).distinct()), nodes)
    frontier = checkpoint(start.select(*key, F.lit(0).alias("distance"), F.lit(0.0).alias("weight"), F.array().cast("array<string>").alias("path")))
    found = frontier
    for depth in range(1, max_depth + 1):
        step = meet(both, frontier.withColumnRenamed("id", "a"), ["a"])
        step = step.select(*task, F.col("b").alias("id"), F.lit(depth).alias("distance"), (F.col("weight") + F.col("w")).alias("weight"), F.concat("path", F.array("relation")).alias("path"), "pull", "relation", "src", "dst")
        order = Window.partitionBy(*key).orderBy(F.desc("weight"), F.desc("pull"), "relation", "src", "dst", "path")
        best = step.join(found.select(*key), key, "left_anti").withColumn("nth", F.row_number().over(order)).where("nth = 1")
        frontier = checkpoint(present(checkpoint(best.select(*key, "distance", "weight", "path")), nodes))
        found = found.unionByName(frontier)
    return found


def distances(pairs: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """id and the number of undirected steps (a, b) from the nearest seed, up to ``max_depth``."""
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    frontier = checkpoint(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    found = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(both, frontier.id == both.a).select(F.col("b").alias("id")).distinct()
        frontier = checkpoint(step.join(found.select("id"), "id", "left_anti").withColumn("distance", F.lit(depth)))
        found = found.unionByName(frontier)
    return found
