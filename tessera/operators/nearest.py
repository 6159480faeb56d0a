"""Nearest-row joins: of the rows with the same key the one at the least distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, distance: Column, right_id: str, within: float | None = None) -> DataFrame:
    """left_id, right_id and distance of the nearest row of ``right`` for each row of ``left``, if any is near enough.

    Of equally near rows the one with the smallest id. The minimum is a partial aggregate on the equi-join."""
    met = left.join(right, key).withColumn("distance", distance)
    if within is not None:
        met = met.where(F.col("distance") < within)
    best = met.groupBy(left_id).agg(F.min(F.struct("distance", right_id)).alias("b"))
    return best.select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.distance").alias("distance"))


def covering(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """``points`` with the columns of the span of the same ``key`` that ``at`` lies in; points in none are left out.

    Spans of a key lie apart from each other. An as-of sweep: points and the starts of spans are one run, over which the last span is carried; a
    key with many points and spans makes no pairs."""
    held = [c for c in spans.columns if c != key]
    span = spans.select(key, F.col(start).alias("_at"), F.lit(0).alias("_sort"), F.struct(*held).alias("_span"), F.lit(None).cast(points.select(F.struct("*").alias("p")).schema["p"].dataType).alias("_point"))
    asks = points.select(key, F.col(at).alias("_at"), F.lit(1).alias("_sort"), F.lit(None).cast(span.schema["_span"].dataType).alias("_span"), F.struct(*points.columns).alias("_point"))
    line = Window.partitionBy(key).orderBy("_at", "_sort").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = span.unionByName(asks).withColumn("_span", F.last("_span", ignorenulls=True).over(line)).where(F.col("_point").isNotNull() & (F.col(f"_span.{end}") >= F.col("_at")))
    return met.select("_point.*", *[F.col(f"_span.{c}").alias(c) for c in held if c not in points.columns])


def closest_scope(points: DataFrame, spans: DataFrame, key: str, outside: int = 100) -> DataFrame:
    """point, span and apart of the closest of ``spans`` (key, start, end, span) for each of ``points`` (key, at, point), if its key has one.

    A span around the point is as far as it is long, another as far as its start plus ``outside``; of equally close ones the first by id. No pairs of a key
    are made: spans around a point are looked for among those of each order of length that lie in the point's block of that length; of those that
    ended before it the last to start, and of those that start after it the first, are carried over the sorted run of points and spans."""
    length = F.col("end") - F.col("start")
    order = F.floor(F.log2(F.greatest(length + 1, F.lit(1)).cast("double"))).cast("int")
    block = lambda c, n: F.shiftright(F.col(c).cast("long"), n)
    laid = spans.where(length >= 0).withColumn("_n", order).withColumn("_size", length)
    laid = laid.select(key, "span", "start", "end", "_size", "_n", F.explode(F.sequence(F.expr("shiftright(cast(`start` as bigint), _n)"), F.expr("shiftright(cast(`end` as bigint), _n)"))).alias("_block"))  # three blocks at most
    orders = sorted(r[0] for r in laid.select("_n").distinct().collect())  # orders of length: a few dozen at most
    asks = points.select(key, "at", "point", F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), block("at", n).alias("_block")) for n in orders or [0]])).alias("_")).select(key, "at", "point", "_.*")
    around = asks.join(laid, [key, "_n", "_block"]).where(F.col("at").between(F.col("start"), F.col("end"))).select("point", F.col("_size").cast("long").alias("apart"), "span")

    def carried(place: str, last: bool) -> DataFrame:
        run = spans.select(key, F.col(place).alias("_at"), F.lit(1).alias("_sort"), F.struct((-F.col("start") if last else F.col("start")).cast("long").alias("s"), "span").alias("s"), F.lit(None).cast(points.schema["point"].dataType).alias("point"))
        both = run.unionByName(points.select(key, F.col("at").alias("_at"), F.lit(0).alias("_sort"), F.lit(None).cast(run.schema["s"].dataType).alias("s"), "point"))
        line = Window.partitionBy(key).orderBy(F.col("_at") if last else F.desc("_at"), "_sort").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return both.withColumn("s", F.min("s").over(line)).where("_sort = 0 and s is not null").select("point", (F.abs(F.abs(F.col("s.s")) - F.col("_at")) + outside).cast("long").alias("apart"), F.col("s.span").alias("span"))

    found = around.unionByName(carried("end", True)).unionByName(carried("start", False))
    return found.groupBy("point").agg(F.min(F.struct("apart", "span")).alias("b")).select("point", "b.*")
