"""The tables of an index as versions of DataFrames: diffs, upserts, cascading deletes, counts.

Rows are changed in sets: a new version of a bucket is its old rows without the touched ones and the new ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.postings import SCHEMA as POSTINGS

#: Schemas of the stored tables.
TABLES = {
    "artifacts": "id string, uri string, path string, kind string, title string, content_hash string, indexed_at timestamp_ntz, metadata string",
    "nodes": "id string, kind string, label string, canonical_name string, artifact_id string, path string, start_line int, end_line int, page int, bbox string, confidence string, metadata string",
    "edges": "id string, src string, dst string, relation string, confidence string, score double, extractor string, evidence_id string, metadata string",
    "chunks": "id string, artifact_id string, kind string, text string, summary string, page int, start_line int, end_line int, token_count int, metadata string",
    "evidence": "id string, artifact_id string, source_uri string, quote string, start_line int, end_line int, page int, bbox string, extractor string, confidence string",
    "context_packs": "id string, task string, mode string, token_budget int, payload_json string, created_at timestamp_ntz",
    "manifests": "key string, value string, updated_at timestamp_ntz",
}


#: Tables of files, of which a run writes only the buckets that it changes; ``links`` (rows like edges) run between files.
FILED = ["artifacts", "nodes", "edges", "chunks", "evidence", "links", "postings"]
SCHEMAS = dict(TABLES, links=TABLES["edges"], postings=POSTINGS)
#: By what the rows of a bucket's file are sorted, for scans that look for one.
SORTED = {"postings": ["term"]}
#: Buckets of the paths of a new index: the share of it that one changed file rewrites.
BUCKETS = 64

LOG = "version long, buckets int, table string, bucket int, rows long"


def names_of(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def bucket_of(path: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def read_or_none(spark: SparkSession, schema: str, *paths: str, base: str | None = None) -> DataFrame | None:
    """Parquet at these paths; None where there is none."""
    try:
        reader = spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows; unlike an empty list of rows, the optimizer knows that and leaves out what is joined with them."""
    return spark.range(1).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


class Stored:
    """The newest state of a stored index: its version, how many buckets its paths have, and its tables with a column bucket.

    A table is a set of buckets, each as the last version that touched it has written it; a log says which. A version counts once its rows are
    in the log, so a failed run changes nothing and readers never see half of one."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder
        log = read_or_none(spark, LOG, f"{folder}/versions")
        newest = [] if log is None else log.groupBy("table", "bucket").agg(F.max(F.struct("version", "rows", "buckets")).alias("m")).select("table", "bucket", "m.*").collect()
        self.version = max((r["version"] for r in newest), default=0)  # a row for each table and bucket
        self.buckets = newest[0]["buckets"] if newest else buckets
        self.places = {t: [f"{folder}/{t}/version={r['version']}/bucket={r['bucket']}" for r in newest if r["table"] == t and r["rows"]] for t in FILED}

    def table(self, name: str, among: list[int] | None = None) -> DataFrame:
        """A table with its column bucket; ``among``: these buckets alone, others are not read."""
        places = [p for p in self.places[name] if among is None or int(p.rsplit("=", 1)[1]) in among]
        schema = f"{SCHEMAS[name]}, bucket int"
        if not places:
            return nothing(self.spark, schema)
        return self.spark.read.schema(f"{schema}, version long").option("basePath", f"{self.folder}/{name}").parquet(*places).drop("version")

    def write(self, tables: dict[str, DataFrame], among: dict[str, list[int]]) -> None:
        """A new version: ``tables`` hold all rows of the buckets ``among``; what isn't among them stays as it is."""
        version, rows = self.version + 1, []
        for t, df in tables.items():
            if not among[t]:
                continue
            path = f"{self.folder}/{t}/version={version}"
            df.select(*names_of(t), "bucket").repartition("bucket").sortWithinPartitions("bucket", *SORTED.get(t, [])).write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = read_or_none(self.spark, f"{SCHEMAS[t]}, bucket int", path)
            counts = {} if written is None else {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}
            rows += [(version, self.buckets, t, b, counts.get(b, 0)) for b in among[t]]
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest version in ``folder``, links among the edges; all are empty where there is none yet."""
    state = Stored(spark, folder)
    tables = {t: state.table(t).drop("bucket") for t in FILED if t != "postings"}
    tables["edges"] = tables["edges"].unionByName(tables.pop("links"))
    return dict(tables, context_packs=logged(spark, folder, "context_packs", ["id"], "created_at"), manifests=manifest(spark, folder))


def append(rows: DataFrame, folder: str, table: str) -> None:
    """Add rows to a table that only grows (packs, manifests): beside the versions, a file for each write."""
    rows.select(*names_of(table)).coalesce(1).write.mode("append").parquet(f"{folder}/{table}")


def logged(spark: SparkSession, folder: str, table: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of a table that only grows; none where nothing has been written."""
    rows = read_or_none(spark, TABLES[table], f"{folder}/{table}")
    return spark.createDataFrame([], TABLES[table]) if rows is None else last_per_key(rows, keys, F.col(order).desc())


def put_manifest(spark: SparkSession, folder: str, values: dict[str, str], updated_at: str) -> None:
    """Set keys of the manifest of a folder; the last value of each counts."""
    rows = spark.createDataFrame(list(values.items()), "key string, value string")
    append(rows.withColumn("updated_at", F.lit(updated_at).cast("timestamp_ntz")), folder, "manifests")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return logged(spark, folder, "manifests", ["key"], "updated_at")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file through Spark's file system, in place of one that is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def last_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of each key the one that comes last."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``delta`` put in or put in place; ``order`` says which of a key's new rows is last."""
    if order:
        delta = last_per_key(delta, keys, F.col(order).desc()).drop(order)
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*base.columns))


def snapshot_diff(now: DataFrame, before: DataFrame, key: str = "path", content: str = "content_hash") -> DataFrame:
    """key and change (new, modified, deleted, unchanged) between two snapshots."""
    a, b = now.select(key, F.col(content).alias("_now")), before.select(key, F.col(content).alias("_before"))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") != F.col("_before"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def cascade_delete(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the artifacts at ``paths`` and all that hangs on them.

    Edges go if either end is a node, chunk or artifact that goes, or if their evidence does."""
    gone = tables["artifacts"].join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("artifact_id"))
    hangs = {t: tables[t].join(gone, "artifact_id", "left_semi").select("id") for t in ("nodes", "chunks", "evidence")}
    ends = gone.select(F.col("artifact_id").alias("id")).unionAll(hangs["nodes"]).unionAll(hangs["chunks"]).distinct()
    edges = tables["edges"]
    for end in ("src", "dst"):
        edges = edges.join(ends.withColumnRenamed("id", end), end, "left_anti")
    edges = edges.join(hangs["evidence"].withColumnRenamed("id", "evidence_id"), "evidence_id", "left_anti")
    out = dict(tables, edges=edges.select(*tables["edges"].columns))
    for t in ("nodes", "chunks", "evidence"):
        out[t] = tables[t].join(gone, "artifact_id", "left_anti").select(*tables[t].columns)
    out["artifacts"] = tables["artifacts"].join(gone.withColumnRenamed("artifact_id", "id"), "id", "left_anti").select(*tables["artifacts"].columns)
    return out


def replace_files(tables: dict[str, DataFrame], delta: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Replace all that the artifacts of ``delta`` had in the index by what they have now."""
    kept = cascade_delete(tables, delta["artifacts"])
    return {t: upsert(kept[t], delta[t], ["id"]) if t in delta else kept[t] for t in kept}


def remove_missing(tables: dict[str, DataFrame], present: DataFrame) -> dict[str, DataFrame]:
    """Drop the artifacts whose paths are no longer there."""
    return cascade_delete(tables, tables["artifacts"].join(present.select("path"), "path", "left_anti"))


def clear_links(edges: DataFrame, extractor: str = "code_document_linker") -> DataFrame:
    return edges.where(F.coalesce("extractor", F.lit("")) != extractor)


def clear_symbols(edges: DataFrame) -> DataFrame:
    return edges.where(~(F.col("id").startswith("scip:") | (F.coalesce("extractor", F.lit("")) == "scip")))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def kind_counts(rows: DataFrame, kind: str = "kind") -> DataFrame:
    return rows.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def plan_counts(changes: DataFrame) -> DataFrame:
    """kind, change and n of a plan (path, kind, change): each pair, the sums over one of the two (null there) and over both; in one pass."""
    return changes.cube("kind", "change").agg(F.count("*").alias("n"), F.grouping("kind").alias("all_kinds"), F.grouping("change").alias("all_changes"))
