"""How filters interact: every order of five filters replayed on every document, as a relation.

A document is a row of flags (which filters it fails). It meets the 120 orders, a literal table that is broadcast; its first
failing step in an order follows from the places of the filters it fails; its five steps are exploded and counted by part, order and
step, with partial sums in each task, so that what is shuffled has 600 rows a part and task at most."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, join_by_key

#: The filters' letters, what a word is, the signs of filter D.
LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """nth, filter_order and, for each letter, its step in the order (from 1): all permutations, 120 of five."""
    rows = [(i, "".join(p), *[p.index(x) + 1 for x in letters]) for i, p in enumerate(permutations(letters))]
    named = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(o).alias("filter_order"), *[F.lit(n).alias(f"at_{x}") for x, n in zip(letters, at)]) for i, o, *at in rows])
    return spark.range(1).select(F.explode(named).alias("o")).select("o.*")


def text_flags(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at a text alone (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": n < 50, "B": 100 * F.size(F.array_distinct(words)) < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(SIGNS)}


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each of ``docs``: part, A to E (fails the filter), good and toxic (labelled 1); written, as it is all that remains of the texts.

    The part is the source (null: empty). E: a smaller doc_id has the same text, anywhere in the table; equal texts are
    known by a 64-bit and a 128-bit hash and their length. A null doc_id has no place among the others: it neither fails E nor makes others fail.
    Labels of repeated doc_ids hold if one says so; other columns are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("x"), F.md5(text).alias("m"), F.octet_length(text).alias("n"))
    found = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), *[f.alias(x) for x, f in text_flags(F.col("text")).items()], key.alias("key"))
    found = checkpoint(found)
    copies = found.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    found = join_by_key(found, checkpoint(copies), ["key"])
    found = found.withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("key", "first_id")
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic")).where("good or toxic")
    known = checkpoint(known)
    return checkpoint(join_by_key(checkpoint(found), known, ["doc_id"]).select("part", *LETTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]))


def replay(flagged: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step, zeros included."""
    spark = flagged.sparkSession
    last = len(letters) + 1
    place = [F.when(F.col(x), F.col(f"at_{x}")).otherwise(last) for x in letters]
    n_failed = sum((F.col(x).cast("int") for x in letters), F.lit(0))
    step = F.explode(F.array(*map(F.lit, range(1, last)))).alias("step")
    # which filters fail, by their steps in the order, as bits: the step's own filter is the bit of its number
    bits = sum((F.when(F.col(x), F.expr(f"shiftleft(1, at_{x})")).otherwise(0) for x in letters), F.lit(0))
    met = flagged.crossJoin(F.broadcast(orders(spark, letters).drop("filter_order")))
    met = met.select("part", "nth", F.least(*place).alias("first"), bits.alias("bits"), (n_failed == 1).alias("one"), "good", "toxic")
    steps = met.select("*", step)
    fails = F.col("bits").bitwiseAND(F.expr("shiftleft(1, step)")) != 0
    removed = F.col("first") == F.col("step")
    count = lambda when, name: F.sum(when.cast("long")).alias(name)
    counted = steps.groupBy("part", "nth", "step").agg(
        count(F.col("first") > F.col("step"), "kept"), count(removed, "removed"), count(fails & (F.col("first") < F.col("step")), "redundant"),
        count(fails & F.col("one"), "unique_fails"), count(removed & F.col("good"), "good_lost"), count(removed & F.col("toxic"), "toxic_lost"),
    )
    named = counted.join(F.broadcast(orders(spark, letters).select("nth", "filter_order")), "nth").withColumn("step", F.col("step").cast("int"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    all_orders = Window.partitionBy("part", letter)
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return named.select("part", "filter_order", "step", *columns, F.sum("removed").over(all_orders).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of all 120 orders on ``docs``; an empty table has no parts and gives no rows, repeated rows count each."""
    return replay(flags(docs, labels))
