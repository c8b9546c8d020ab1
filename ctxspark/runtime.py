"""Session helpers: cutting lineage in the shared folder, scratch tables, table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where it is unset and Spark is local (tests, a laptop) a local folder is made and set; on a
    cluster ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ctxspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and goes on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, but columnar and compressed: for wide or large intermediate tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ctxspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that `written` made, once everything that reads it has run."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
