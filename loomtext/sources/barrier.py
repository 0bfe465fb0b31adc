"""A barrier between steps: write a table to the shared folder and read it again.

It cuts lineage, fixes what is not deterministic, and lets later steps read columns of
what would otherwise be computed anew for each use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session uses a folder under /tmp; a cluster has none that
    is known to be shared, which is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        sc.setCheckpointDir(f"file:///tmp/loomtext-{uuid.uuid4().hex[:12]}")
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from Parquet files in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
