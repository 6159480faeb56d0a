"""Stored postings: what BM25 needs of each term, by blocks of texts, and a top-k that reads few of them.

A row is a term in a block of texts: in how many texts it is, the most often it is in one, the shortest of these, and the texts themselves.
From the first three follows the most that the term can add to a score there; the sum over a query's terms bounds every text of the block. So the
best blocks are scored first, and of the others those alone whose bound reaches the k-th best score. The row of the empty term holds the
block's number of texts and their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators.lineage import checkpoint
from tessera.operators.joins import SMALL_ROWS

SCHEMA = "term string, n long, most_tf long, least_length long, total_length long, entries array<struct<id:string,tf:long,length:long>>"
#: Texts of a block, about; blocks that are scored at first for each query; digits to which scores count as equal.
BLOCK_TEXTS, FIRST_BLOCKS, DIGITS = 4096, 4, 9


def postings(texts: DataFrame, blocks: int = 0) -> DataFrame:
    """SCHEMA and block of texts (id, text, block). Texts without a term count nowhere, null texts are such.

    Texts are dealt by their blocks, whole, before their terms become rows: those are never shuffled, and each block is made in one task.
    With ``blocks``, how many there are, a task has few of them."""
    tasks = max(4 * texts.sparkSession.sparkContext.defaultParallelism, 2 * blocks)
    terms = texts.select("id", "block", tokenize("text").alias("terms")).repartition(tasks, "block").withColumn("length", F.size("terms")).where("length > 0")
    each = F.explode(F.concat("terms", F.array(F.lit(""))))  # the empty term is once in each text
    held = terms.select("id", "block", "length", each.alias("term")).groupBy("term", "block", "id", "length").agg(F.count("*").alias("tf"))
    of_term = lambda c: F.when(F.col("term") != "", c)
    entry = F.struct(F.col("id").cast("string").alias("id"), "tf", F.col("length").cast("long").alias("length"))
    rows = held.groupBy("block", "term").agg(
        F.count("*").alias("n"), F.max(of_term(F.col("tf"))).alias("most_tf"), F.min(of_term(F.col("length"))).cast("long").alias("least_length"),
        F.sum(F.when(F.col("term") == "", F.col("length"))).alias("total_length"), F.sort_array(F.collect_list(of_term(entry))).alias("entries"),
    )
    return rows.withColumn("entries", of_term(F.col("entries"))).select(*[c.split()[0] for c in SCHEMA.split(", ")], "block")


def gain(tf: str | Column, length: str | Column, mean: Column, k1: float, b: float) -> Column:
    """What a term adds for each unit of its idf: more if it is there more often, less if the text is longer."""
    tf, length = (F.col(c) if isinstance(c, str) else c for c in (tf, length))
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def topk(stored: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, first: int = FIRST_BLOCKS) -> DataFrame:
    """query_id, id and score of the ``k`` texts with the highest BM25 for each query (query_id, term; few); equal scores by id.

    ``stored``: rows of ``postings``. Only the rows of the queries' terms are read, and first without their texts."""
    wanted = checkpoint(queries.distinct())
    if wanted.count() > SMALL_ROWS:
        raise ValueError("queries are broadcast; give them in parts")
    size = stored.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.sum("total_length").alias("total")).first()
    texts, mean = size["texts"], F.lit(float(size["total"] or 1) / max(1, size["texts"]))
    terms = [r[0] for r in wanted.select("term").distinct().limit(1000).collect()]
    rows = stored.where("term <> ''")
    if len(terms) < 1000:  # a filter that the scan can use; the join would do without
        rows = rows.where(F.col("term").isin(terms))
    heads = rows.drop("entries").join(F.broadcast(wanted.select("term").distinct()), "term")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = checkpoint(df.select("term", F.log(1 + (F.lit(texts) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    weighed = F.broadcast(wanted.join(idf, "term"))
    bounds = heads.join(weighed, "term").groupBy("query_id", "block").agg(F.sum(F.col("idf") * gain("most_tf", "least_length", mean, k1, b)).alias("bound"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    bounds = checkpoint(bounds.withColumn("nth", nth))

    def scores(blocks: DataFrame) -> DataFrame:
        held = rows.select("term", "block", "entries").join(weighed, "term").join(blocks.select("query_id", "block"), ["query_id", "block"])
        one = held.select("query_id", "idf", F.explode("entries").alias("e"))
        return one.groupBy("query_id", F.col("e.id").alias("id")).agg(F.round(F.sum(F.col("idf") * gain("e.tf", "e.length", mean, k1, b)), DIGITS).alias("score"))

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("place", place).where(F.col("place") <= k)

    begun = checkpoint(best(scores(bounds.where(F.col("nth") <= first))))
    least = begun.where(F.col("place") == k).select("query_id", F.col("score").alias("least"))  # none where fewer are found
    more = bounds.where(F.col("nth") > first).join(F.broadcast(least), "query_id", "left")
    more = more.where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) + 10.0**-DIGITS >= F.col("least")))
    return best(begun.drop("place").unionByName(scores(more))).select("query_id", "id", "score")
