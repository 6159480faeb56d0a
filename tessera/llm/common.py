"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are handed on in groups of about this many bytes.
GROUP_CHARS = 4_000_000
#: Bytes of an Arrow batch, about: what JVM and worker each hold of a task's rows at a time.
BATCH_BYTES = 4_000_000
#: Rows that a broadcast table of a few narrow columns may have.
SMALL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints.

    A folder of our own is set only where the session names none and the master is local (tests, notebooks): on
    a cluster a machine's own folder would be no use to the executors, so that raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours through Spark's file system, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_below(hashed: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash lies in the lowest ``share`` (0 to 1) of all: a sample as fine as one in 2 ** 53."""
    return hashed.cast("double") < (F.lit(share) if isinstance(share, float) else share) * 2.0**64 - 2.0**63


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: the lineage is cut, and a lost executor loses nothing."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: What this Python worker keeps between tasks, for one operator at a time.
_kept: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], object]):
    """What an operator keeps in a Python worker from task to task; another operator's is dropped for it."""
    if name not in _kept:
        release_caches(name)
        _kept[name] = make()
    return _kept[name]


def release_caches(but: str | None) -> None:
    old = [n for n in _kept if n != but]
    for name in old:
        del _kept[name]
    if old:
        gc.collect()
    give_back()


def give_back() -> None:
    """Return the worker's free memory to the system: an allocator keeps blocks of past batches and tasks otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without it
        pass


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of the session to BATCH_BYTES, as rows hold whole texts; a limit that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def groups_by_size(sizes: list[int], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts of these sizes that hold at most ``limit`` together, or one text."""
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(df: DataFrame, keep: list[str], make: Callable[[], Callable[[list[str | None]], tuple]], made: str, text: str = "text", arrow_text: bool = False, group: int = GROUP_CHARS, cache: str | None = None) -> DataFrame:
    """Run a function over the column ``text``, a bounded group of rows at a time.

    ``make()`` runs once in each task and returns the function. That gets the texts of a group (a list, or an
    Arrow array with ``arrow_text``) and returns ``(rows, columns)``: the columns named in the schema string
    ``made``, and for each of their values the index of its row in the group (None: one value for each row, in
    order). The columns ``keep`` of the row go along. ``group``: bytes of text in a group, about;
    ``cache``: name of what may stay in the worker."""
    from pyspark.sql.types import StructType

    limit_batches(df.sparkSession)
    (held,) = free_names(df, "_text")
    source = df.select(*keep, F.col(text).alias(held))
    schema = StructType([source.schema[c] for c in keep] + list(StructType.fromDDL(made).fields))
    names = [f.name for f in schema.fields[len(keep) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        release_caches(cache)
        call = make()
        for batch in batches:
            column = batch.column(len(keep))
            for a, b in groups_by_size(pc.fill_null(pc.binary_length(column), 0).to_pylist(), group):
                part = batch.slice(a, b - a)
                text_part = part.column(len(keep))
                rows, columns = call(text_part if arrow_text else text_part.to_pylist())
                kept = [part.column(i) for i in range(len(keep))]
                if rows is not None:
                    at = pa.array(rows, pa.int64())
                    kept = [c.take(at) for c in kept]
                new = [pa.array(columns[n], arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept, arrow)] + new, schema=arrow)
        del call
        give_back()

    return source.mapInArrow(run, schema)


def with_text_column(df: DataFrame, name: str, make: Callable[[], Callable[[list[str | None]], list]], kind: str, group: int = GROUP_CHARS) -> DataFrame:
    """``df`` with a column made from the column ``text``: only that goes to Python, other columns stay in the JVM.

    ``name`` must be free in ``df``. ``make()`` runs once in each task and returns the function, which gets a bounded group of texts."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    limit_batches(df.sparkSession)
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        release_caches(None)
        call = make()
        for texts in batches:
            out = []
            for a, b in groups_by_size(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), group):
                out += call(texts.slice(a, b - a).to_pylist())
            yield pa.array(out, arrow)
        del call
        give_back()

    return df.withColumn(name, run(F.col("text")))


def small_or_not(table: DataFrame) -> DataFrame:
    """A table of a few narrow columns, marked for broadcast if it is counted to have at most SMALL_ROWS."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of a few narrow columns: by broadcast if it is counted to have at most SMALL_ROWS, else by shuffle."""
    return big.join(small_or_not(small), keys, how)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of one key from which a shuffle join would put too many into one task.
HOT_ROWS = 100_000


def join_by_key(big: DataFrame, small: DataFrame, keys: list[str], limit: int = SMALL_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """``big`` left joined with a table of a few narrow columns that has one row for each key at most.

    Up to ``limit`` rows of ``small`` are broadcast. Beyond that keys with over ``hot`` rows of ``big`` (at most one for
    each ``hot`` rows of it) are counted and their rows of ``small`` broadcast, rows with a null key take no part, and only the rest is
    shuffled: no task gets more of one key than ``hot``. ``big`` is read more than once, so it should be a written table."""
    if small.count() <= limit:
        return big.join(F.broadcast(small), keys, "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    crowded = checkpoint(big.where(known).groupBy(*keys).count().where(F.col("count") > hot).select(*keys))
    few = small.join(F.broadcast(crowded), keys, "left_semi")
    rest = big.where(known).join(F.broadcast(crowded), keys, "left_anti").join(small, keys, "left")
    met = big.join(F.broadcast(crowded), keys, "left_semi").join(F.broadcast(few), keys, "left")
    more = [c for c in small.columns if c not in keys]
    unknown = big.where(~known).select("*", *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in more])
    return rest.unionByName(met).unionByName(unknown.select(*rest.columns))
