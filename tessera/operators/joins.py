"""Joins that stay even where one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import checkpoint

#: Rows that a broadcast table of a few narrow columns may have.
SMALL_ROWS = 1_000_000
#: Rows of one key beyond which they are dealt over several tasks.
HOT_ROWS = 100_000


def small(df: DataFrame, limit: int = SMALL_ROWS):
    """What to put around ``df`` (written), or what it is reduced to, in a join: a broadcast if it is counted to have ``limit`` rows at most, else nothing."""
    return F.broadcast if df.count() <= limit else (lambda rows: rows)


def present(rows: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` (written, and mostly few) whose key is one of those of ``nodes``, which are many: these are shuffled only if ``rows`` are many, too."""
    if rows.count() > SMALL_ROWS:
        return rows.join(nodes.select(key), key, "left_semi").select(*rows.columns)
    held = nodes.select(key).join(F.broadcast(rows.select(key).distinct()), key, "left_semi").distinct()
    return rows.join(F.broadcast(held), key, "left_semi").select(*rows.columns)


def meet(many: DataFrame, few: DataFrame, keys: list[str], limit: int = SMALL_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``many`` with a reduced table of a few rows for each key.

    Up to ``limit`` rows of ``few`` are broadcast. Beyond that both are shuffled; keys with over ``hot`` rows of ``many`` are counted first, those rows
    are dealt over parts, and the rows of ``few`` for these keys alone are copied to the parts."""
    few = checkpoint(few)
    if few.count() <= limit:
        return many.join(F.broadcast(few), keys)
    many = checkpoint(many)
    crowded = checkpoint(many.groupBy(*keys).agg(F.ceil(F.count("*") / hot).cast("int").alias("_parts")).where("_parts > 1"))  # a row for each ``hot`` of ``many`` at most
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(F.broadcast(crowded), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    copied = few.join(F.broadcast(crowded), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"]).drop("_part")


def by_frequency(sets: list[DataFrame], most: int = SMALL_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """The sets (id, terms) with their terms in one order for all, seldom ones first, and the counts of the frequent terms (term, n).

    Any order that all sets share gives the same overlaps; so it is enough to know the frequent terms, of which there are ``most`` at
    most: those that make up over one in ``most`` of all terms."""
    sets = [checkpoint(s) for s in sets]
    terms = sets[0].select(F.explode("terms").alias("term"))
    for s in sets[1:]:
        terms = terms.unionAll(s.select(F.explode("terms").alias("term")))
    counts = checkpoint(terms.groupBy("term").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = checkpoint(counts.where(F.col("n") > max(1, total // most)))
    known = F.broadcast(frequent)
    place = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")
    names = lambda a: F.transform(a, lambda x: x["term"])
    return [s.select("id", F.explode("terms").alias("term")).join(known, "term", "left").groupBy("id").agg(names(F.array_sort(F.collect_list(place))).alias("terms")) for s in sets], frequent


def overlaps(left: DataFrame, right: DataFrame, least: int = 2, hot: int = 10_000) -> DataFrame:
    """l_id, r_id and shared of every pair of sets (id, terms: distinct) that share ``least`` terms or more.

    A frequency-ordered prefix filter: who shares ``least`` terms shares one besides the ``least - 1`` most frequent of either set, so
    only the seldom rest of a set looks for partners, and a term that all sets hold brings none. A pair is found at the first such term that both
    hold, and its overlap counted there. Terms that over ``hot`` sets look for are dealt over parts."""
    least_terms = F.size("terms") >= least
    (l_sets, r_sets), frequent = by_frequency([left.where(least_terms).select("id", "terms"), right.where(least_terms).select("id", "terms")])
    seldom = F.slice("terms", F.lit(1), F.size("terms") - (least - 1))
    parts = F.coalesce(F.ceil(F.col("n") / hot), F.lit(1)).cast("int")
    ask = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("terms").alias(f"{s}_terms"), F.explode(seldom).alias("term")).join(F.broadcast(frequent), "term", "left").withColumn("_parts", parts).drop("n")
    l_side = ask(l_sets, "l").withColumn("_part", F.pmod(F.xxhash64("l_id"), F.col("_parts")).cast("int")).drop("_parts")
    r_side = ask(r_sets, "r").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    met = l_side.join(r_side, ["term", "_part"]).withColumn("both", F.array_intersect("l_terms", "r_terms"))
    return met.where((F.size("both") >= least) & (F.element_at("both", 1) == F.col("term"))).select("l_id", "r_id", F.size("both").alias("shared"))
