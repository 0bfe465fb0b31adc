"""A session with the settings the library expects."""

from __future__ import annotations

import importlib.util
import sys

import pyspark
from pyspark.sql import DataFrame, SparkSession

from loomtext.sources.barrier import fresh_path

#: Cores, shuffle partitions and scan split by profile for one host.
PROFILES = {"daily": ("local[2]", 4, "32m"), "balanced": ("local[4]", 8, "48m"), "full": ("local[8]", 16, "64m")}


def session(profile: str = "balanced", name: str = "loomtext") -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster use its own."""
    master, parts, split = PROFILES[profile]
    return (
        SparkSession.builder.master(master).appName(name).config("spark.sql.shuffle.partitions", parts).config("spark.sql.files.maxPartitionBytes", split)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def doctor(spark: SparkSession) -> DataFrame:
    """(check, ok, detail) of what the library needs from a session and its hosts."""
    found = [("python", sys.version_info >= (3, 11), sys.version.split()[0]), ("pyspark", int(pyspark.__version__.split(".")[0]) >= 4, pyspark.__version__)]
    found += [(name, importlib.util.find_spec(name) is not None, "import") for name in ("numpy", "pandas", "pyarrow", "xxhash")]
    path = fresh_path(spark, "doctor")
    spark.range(100).repartition(4).write.parquet(path)
    found.append(("shared_folder", spark.read.parquet(path).count() == 100, path.rsplit("/", 1)[0]))
    rows = spark.range(8).mapInArrow(lambda batches: batches, "id long").count()
    found.append(("arrow_workers", rows == 8, str(rows)))
    return spark.createDataFrame(found, "check string, ok boolean, detail string")
