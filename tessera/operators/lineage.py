"""Cuts of a plan's lineage by writes to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints that the cluster shares; a folder of our own only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a write to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, plain: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage by a table in the shared folder, of which a reader takes the columns that it needs: for wide rows that are read often.

    With ``plain`` columns it is not compressed, and these have no dictionary: readers deal it over tasks by its bytes, and long texts that many
    rows repeat would come to few tasks."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    how = {"compression": "uncompressed"} | {f"parquet.enable.dictionary#{c}": "false" for c in plain} if plain else {}
    df.write.options(**how).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
