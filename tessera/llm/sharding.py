"""Shards of near equal bytes from indivisible groups, by Karmarkar-Karp differencing.

Groups (equal texts) are dealt to buckets. Each bucket is differenced on its own: the partial partitions with the
largest spreads are combined, the largest part of one with the smallest of the other, until one is left. The
partitions of the buckets, one row each, are then differenced the same way, FAN of them in a task, level by level."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, join_small, shuffle_width

#: Groups of a bucket, about, and partitions that are combined at a time on the levels above.
GROUPS, FAN = 20_000, 4096


def difference(sizes: list[tuple[int, ...]]) -> list[list[int]]:
    """For each partial partition (sizes of its parts) the part of the result that each of its parts goes to."""
    k = max(map(len, sizes), default=0)
    # a part is None, a leaf (partition, part) or a pair of parts
    heap = []
    for i, parts in enumerate(sizes):
        order = sorted(range(len(parts)), key=lambda p: (-parts[p], p))
        heap.append((parts[order[-1]] - parts[order[0]], i, [parts[p] for p in order], [(i, p) for p in order]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, trees = heapq.heappop(heap)
        _, _, b, others = heapq.heappop(heap)
        joined = sorted(((a[i] + b[k - 1 - i], i) for i in range(k)), key=lambda x: -x[0])
        sums = [s for s, _ in joined]
        forest = [[trees[i], others[k - 1 - i]] for _, i in joined]
        tie += 1
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, forest))
    out = [[0] * len(p) for p in sizes]
    for part, tree in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += node
            else:
                out[node[0]][node[1]] = part
    return out


def _single(size: int, k: int) -> tuple[int, ...]:
    return (size, *[0] * (k - 1))


def number_within(rows: DataFrame, group: str, spread: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, a group over as many tasks as there are.

    Rows are dealt by a hash of ``spread``; counts of the parts, shuffle width for each group, give their bases."""
    n = 4 * shuffle_width(rows.sparkSession)
    parts = checkpoint(rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int")))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy(group, "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*spread)) - 1
    return join_small(parts, checkpoint(bases), [group, "_part"]).withColumn(name, F.col("_base") + nth).drop("_part", "_base")


def _combined(parted: DataFrame, buckets: int, shards: int, fan: int) -> DataFrame:
    """(bucket, part, shard) of the partitions of ``buckets`` buckets (rows bucket, part, bytes): FAN at a time become
    one of the level above, until one is left; its parts are the shards."""

    def join_up(pdf):
        import pandas as pd

        wide = pdf.pivot_table(index="bucket", columns="part", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0).sort_index()
        to = difference([tuple(int(x) for x in row) for row in wide.to_numpy()])
        rows = [(int(b), p, int(pdf["up"].iloc[0]), t, int(s)) for b, sizes, places in zip(wide.index, wide.to_numpy(), to) for p, (s, t) in enumerate(zip(sizes, places))]
        return pd.DataFrame(rows, columns=["bucket", "part", "up", "up_part", "bytes"])

    level = parted.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    home = None  # (bucket of the lowest level, part) -> (node, part) of the level reached
    while True:
        steps = checkpoint(level.withColumn("up", F.floor(F.col("bucket") / fan).cast("int")).groupBy("up").applyInPandas(join_up, "bucket int, part int, up int, up_part int, bytes long"))
        places = steps.select(F.col("bucket").alias("node"), F.col("part").alias("node_part"), "up", "up_part")
        if home is None:
            home = places.withColumnRenamed("node", "bucket").withColumnRenamed("node_part", "part")
        else:
            home = join_small(home.withColumnRenamed("up", "node").withColumnRenamed("up_part", "node_part"), places, ["node", "node_part"]).select("bucket", "part", "up", "up_part")
        buckets = -(-buckets // fan)
        if buckets <= 1:
            return checkpoint(home.select("bucket", "part", F.col("up_part").alias("shard")))
        level = steps.groupBy(F.col("up").alias("bucket"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes"))


def shard(docs: DataFrame, shards: int = 8, groups_each: int = GROUPS, fan: int = FAN) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; rows with equal texts are in one shard.

    size: bytes of the text and 1; null and empty texts are one group. A slot is the place in its shard, from 0
    without gaps. Repeated rows have a slot each; an empty table gives no rows; other columns are left out.
    A group with more than its share of the bytes keeps its shard that much above the others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    key = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg((F.count("*") * F.col("size")).alias("bytes"))
    groups = checkpoint(groups)
    n = groups.count()
    buckets = max(1, -(-n // groups_each), min(shuffle_width(docs.sparkSession), n // 500))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("text_hash", F.lit(1)), F.lit(buckets)).cast("int"))

    def part(pdf):
        pdf = pdf.sort_values(["bytes", "text_hash", "text_crc32"], ascending=False, ignore_index=True)
        pdf["part"] = [p[0] for p in difference([_single(int(b), shards) for b in pdf["bytes"]])]
        return pdf[[*key, "bytes", "bucket", "part"]]

    parted = checkpoint(dealt.groupBy("bucket").applyInPandas(part, "text_hash long, text_crc32 long, size long, bytes long, bucket int, part int"))
    to = _combined(parted, buckets, shards, fan)
    home = join_small(parted, to, ["bucket", "part"]).select(*key, "shard")
    placed = rows.join(home, key)
    return number_within(placed, "shard", ["row"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
