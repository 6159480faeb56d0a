"""Merkle manifest of a dataset: a hash tree over the rows of each group and one over the groups' roots.

Rows are reduced to their digests (leaves) and placed by a distributed sort. 4096 consecutive leaves of a group are a block,
which is a whole subtree of three levels, as nodes have 16 children; executors hand blocks to DuckDB as Arrow tables, where
ordered ``string_agg`` and ``sha256`` make one level after another. Spark combines the blocks' roots in the same way, 16 at a
time, and brings every block the runs above it, from which DuckDB makes the proofs of its rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import ascii_lower, checkpoint, join_by_key, join_small

#: Children of a node.
ARITY = 16
#: Levels that a block holds, and its leaves: a power of ARITY, so that blocks are whole subtrees.
INNER = 3
BLOCK = ARITY**INNER
#: Leaves that a task hands to DuckDB at a time, about; whole blocks always.
BATCH = 2 * BLOCK
#: DuckDB's share of a worker's memory.
MEMORY = "300MB"

PATH = "array<struct<joined:string,place:int>>"


def field(value: Column) -> Column:
    """A value as the leaf hashes it: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*columns: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the columns' fields."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with pos (long, from 0 in its group by ``order``) and size (rows of the group); no group is sorted in one task.

    Rows are laid out by range and written; a partition's runs of groups are counted, and the counts of the partitions before are added
    to a row's place in its own. Equal rows are laid out by their place in the input."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    laid = checkpoint(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = checkpoint(runs.select(group, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size")))
    return join_small(laid, runs, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def levels_of(size: Column | int, arity: int = ARITY, most: int = 16) -> Column | int:
    """How often ``size`` nodes are hashed in runs until one is left."""
    if isinstance(size, int):
        return next(n for n in range(64) if arity**n >= size)
    return sum(((size > arity**n).cast("int") for n in range(1, most)), (size > 1).cast("int"))


def _joined(nodes: DataFrame) -> DataFrame:
    """grp, run, n and the joined nodes of every run of ARITY neighbours."""
    run = F.floor(F.col("idx") / ARITY).cast("long").alias("run")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"])
    return nodes.groupBy("grp", run, "n").agg(F.array_join(parts, "").alias("joined"))


def fold(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, roots) of the trees over nodes (grp, idx, n nodes of the group, node), level by level.

    paths: grp, idx and, from the bottom to the top, the joined run that holds the node and its place there; roots: grp, root.
    A group of one node is its own root. Every join brings a run to its own 16 nodes at most."""
    nodes = checkpoint(nodes)
    most = nodes.agg(F.max("n")).first()[0] or 0
    level, made = nodes, []
    for i in range(levels_of(int(most)) if most else 0):
        runs = checkpoint(_joined(level.where(F.col("n") > ARITY**i)))
        made.append(runs)
        level = runs.select("grp", F.col("run").alias("idx"), "n", F.sha2("joined", 256).alias("node"))
    roots = nodes.where("n = 1").select("grp", F.col("node").alias("root"))
    for i, runs in enumerate(made):
        roots = roots.unionByName(runs.where(F.col("n") <= ARITY ** (i + 1)).select("grp", F.sha2("joined", 256).alias("root")))
    above = None
    none = F.array().cast(PATH)
    parent = F.floor(F.col("idx") / ARITY).cast("long")
    step = lambda: F.array(F.struct("joined", (F.col("idx") % ARITY).cast("int").alias("place")))
    for runs in reversed(made):  # from the top: what stands above a run is its parent's run and what stands above that
        if above is None:
            above = runs.select("grp", "run", "joined", none.alias("up"))
        else:
            up = above.select("grp", F.col("run").alias("over"), F.col("joined").alias("_j"), F.col("up").alias("_up"))
            here = runs.withColumn("over", F.floor(F.col("run") / ARITY).cast("long")).join(up, ["grp", "over"], "left")
            own = F.array(F.struct(F.col("_j").alias("joined"), (F.col("run") % ARITY).cast("int").alias("place"))).cast(PATH)
            above = here.select("grp", "run", "joined", F.when(F.col("_j").isNull(), none).otherwise(F.concat(own, F.col("_up"))).alias("up"))
        above = checkpoint(above)
    if above is None:
        return nodes.select("grp", "idx", none.alias("path")), roots
    met = nodes.withColumn("run", parent).join(above, ["grp", "run"], "left")
    return met.select("grp", "idx", F.when(F.col("joined").isNull(), none).otherwise(F.concat(step().cast(PATH), F.col("up"))).alias("path")), roots


def _level_sql(top: int) -> list[str]:
    """Nodes and runs of a batch's blocks as common tables: n0, r0, n1, ... ``rows``: b (block), pos (in the block), leaf, levels."""
    out = ["n0 as materialized (select b, pos, leaf as node, levels from rows)"]
    for i in range(top):
        out.append(f"r{i} as materialized (select b, pos // {ARITY} as run, levels, string_agg(node, '' order by pos) as joined from n{i} where levels > {i} group by b, pos // {ARITY}, levels)")
        out.append(f"n{i + 1} as materialized (select b, run as pos, sha256(joined) as node, levels from r{i})")
    return out


def root_sql() -> str:
    """b and root of every block of a batch."""
    ends = " union all ".join(f"select b, node as root from n{i} where levels = {i}" for i in range(INNER + 1))
    return f"with {', '.join(_level_sql(INNER))} {ends} order by b"


def proof_sql(outer: int) -> str:
    """n, proof_sha256 and folded_root of every row; ``above``: b and path, the runs over its block and the places in them; ``outer``: the most of these."""
    width, steps = 64, []
    say = lambda joined, at: f"substr({joined}, 1, {width} * {at}) || substr({joined}, {width} * {at} + {width + 1})"
    put = lambda joined, at: f"sha256(substr({joined}, 1, {width} * {at}) || fold || substr({joined}, {width} * {at} + {width + 1}))"
    for i in range(INNER):
        at = f"(d.pos // {ARITY**i} % {ARITY})"
        steps.append(
            f"d{i + 1} as (select d.n, d.b, d.pos, case when r.joined is null then proof else proof || {say('r.joined', at)} end as proof, case when r.joined is null then fold else {put('r.joined', at)} end as fold"
            f" from d{i} d left join r{i} r on r.b = d.b and r.run = d.pos // {ARITY ** (i + 1)})"
        )
    steps.append(f"e0 as (select d.n, d.proof, d.fold, a.path from d{INNER} d join above a on a.b = d.b)")
    for i in range(outer):
        joined, at = f"path[{i + 1}].joined", f"path[{i + 1}].place"
        steps.append(f"e{i + 1} as (select n, path, case when len(path) > {i} then proof || {say(joined, at)} else proof end as proof, case when len(path) > {i} then {put(joined, at)} else fold end as fold from e{i})")
    first = "d0 as (select n, b, pos, '' as proof, coalesce(held, leaf) as fold from rows)"
    return f"with {', '.join([*_level_sql(INNER), first, *steps])} select n, sha256(proof) as proof_sha256, fold as folded_root from e{outer} order by n"


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks, of about BATCH rows; ``begins`` marks the first row of a block."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(table["begins"].to_numpy())[-1])  # the last block may go on
        for at in _cuts(table.slice(0, cut)):
            yield at
        held = table.slice(cut).combine_chunks().to_batches()
        rows = table.num_rows - cut
    if held:
        yield from _cuts(pa.Table.from_batches(held))


def _cuts(table: pa.Table) -> Iterator[pa.Table]:
    import numpy as np

    starts = np.flatnonzero(table["begins"].to_numpy()) if table.num_rows else np.zeros(0, int)
    a = 0
    for b, after in zip(starts, [*starts[1:], table.num_rows]):
        if after - a > BATCH and b > a:
            yield table.slice(a, b - a)
            a = int(b)
    if table.num_rows > a:
        yield table.slice(a)


def _engine(rows: DataFrame, schema: StructType, keep: list[str], sql: str, made: list[str]) -> DataFrame:
    """Run ``sql`` on the blocks of each task; ``rows`` are sorted so that blocks lie together. With a column path, the first row of a block
    is that of the runs above it; else every row is a leaf, and a row comes out for each block."""
    proofs = "path" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        for table in _whole_blocks(batches):
            begins = table["begins"].to_numpy()
            block = np.cumsum(begins) - 1
            leaf = np.flatnonzero(~begins) if proofs else np.arange(len(begins))
            names = [c for c in ("pos", "levels", "leaf", "held") if c in table.column_names]
            given = table.select(names).take(leaf).append_column("b", pa.array(block[leaf])).append_column("n", pa.array(leaf))
            con.register("rows", given)
            if proofs:
                con.register("above", table.select(["path"]).filter(table["begins"]).append_column("b", pa.array(np.arange(int(begins.sum())))))
            found = con.sql(sql).to_arrow_table()
            kept = table.take(leaf if proofs else np.flatnonzero(begins))
            columns = [kept[c] for c in keep] + [found[c] for c in made]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches()
            con.unregister("rows")
        con.close()

    return rows.mapInArrow(run, schema)


@dataclass
class Manifest:
    """rows: grp, pos, size, leaf and what was given along; above: grp, block, path, root of a block's group (subroot); groups: grp, subroot; root of all."""

    rows: DataFrame
    above: DataFrame
    groups: DataFrame
    root: str | None
    height: int  # the longest path above a block


def build(rows: DataFrame, order: str = "id") -> Manifest:
    """The hash tree over rows (grp, a non-null string by which groups stand in order; ``order``; leaf; any other narrow columns).

    Rows of a group stand in the order of ``order`` (null first), equal ones by leaf."""
    placed = numbered(rows, "grp", order, "leaf")
    placed = checkpoint(placed.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")))
    levels = F.least(F.lit(INNER), levels_of(F.col("size"), most=INNER + 1)).alias("levels")
    inside = (F.col("pos") % BLOCK).alias("pos")
    dealt = placed.select("grp", "block", inside, levels, "leaf", "size", (inside == 0).alias("begins"))
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    schema = StructType([dealt.schema[c] for c in ("grp", "block", "size")]).add("root", "string")
    blocks = _engine(dealt, schema, ["grp", "block", "size"], root_sql(), ["root"])
    count = F.ceil(F.col("size") / BLOCK).cast("long")
    paths, subroots = fold(blocks.select("grp", F.col("block").alias("idx"), count.alias("n"), F.col("root").alias("node")))
    groups = checkpoint(subroots.withColumnRenamed("root", "subroot"))
    outer = numbered(groups.select(F.lit("").alias("all"), "grp", "subroot"), "all", "grp")
    tops, roots = fold(outer.select(F.col("all").alias("grp"), F.col("pos").alias("idx"), F.col("size").alias("n"), F.col("subroot").alias("node")))
    named = outer.select("grp", "subroot", F.col("pos").alias("idx")).join(tops.select("idx", F.col("path").alias("top")), "idx").drop("idx")
    root = roots.first()  # one row
    above = join_by_key(checkpoint(paths.withColumnRenamed("idx", "block")), checkpoint(named), ["grp"])
    above = checkpoint(above.select("grp", "block", F.concat("path", "top").alias("path"), "subroot"))
    height = above.agg(F.max(F.size("path"))).first()[0] or 0
    return Manifest(placed, above, groups, root["root"] if root else None, height)


def prove(manifest: Manifest, held: str, keep: list[str]) -> DataFrame:
    """``keep``, leaf, subroot, root, proof_sha256 (of all siblings, from the bottom to the top), folded_root and verified of every row.

    ``held``: a column of ``manifest.rows`` with the leaf as it is held now, null where it is the same. The root is folded anew from it and the siblings
    that the manifest has."""
    rows = manifest.rows
    levels = F.least(F.lit(INNER), levels_of(F.col("size"), most=INNER + 1))
    leaves = rows.select("grp", "block", *keep, (F.col("pos") % BLOCK).alias("pos"), levels.alias("levels"), "leaf", F.col(held).alias("held"), F.lit(None).cast(PATH).alias("path"), F.lit(False).alias("begins"))
    heads = manifest.above.select("grp", "block", F.lit(-1).cast("long").alias("pos"), "path", F.lit(True).alias("begins"))
    dealt = leaves.unionByName(heads, allowMissingColumns=True).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    kept = ["grp", *keep, "leaf"]
    schema = StructType([dealt.schema[c] for c in kept]).add("proof_sha256", "string").add("folded_root", "string")
    proved = _engine(dealt, schema, kept, proof_sql(manifest.height), ["proof_sha256", "folded_root"])
    named = join_small(proved, manifest.groups, ["grp"]) if manifest.root else proved.withColumn("subroot", F.lit(None).cast("string"))
    root = F.lit(manifest.root).cast("string")
    return named.select(*keep, "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``, a group for each source.

    Rows whose doc_id's CRC is divisible by 5 are checked against a text whose A-Z are lower-cased. Null values count as such; a null source is a group, which
    comes first; a null doc_id comes first in its group and is not tampered with; repeated rows are leaves of their own, in the order of
    their leaves; other columns are left out; an empty table gives no rows. Texts are hashed in the scan, digests alone are shuffled."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*columns, F.col("text"))
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, digest(*columns, ascii_lower(F.col("text"))))
    group = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = checkpoint(docs.select(group.alias("grp"), F.col("doc_id").alias("id"), leaf.alias("leaf"), changed.alias("held")))
    return prove(build(rows), "held", ["id"]).withColumnRenamed("id", "doc_id")
