"""Tables written to the cluster's shared folder, which end a plan's lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return f"file://{_OWN[sc.applicationId]}"


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder's URI for one run of an operator."""
    at = shared_dir(spark).rstrip("/")
    at = at if "://" in at or at.startswith("file:") else f"file://{os.path.abspath(at)}"
    return f"{at}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: lineage ends here and no executor's loss matters."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(df with _row from 0 on, how many): counts of a partition each go to the driver, no rows."""
    at = written(df.withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = dict(at.groupBy("_part").count().collect())
    start, first = 0, {}
    for p in sorted(counts):
        first[p] = start
        start += counts[p]
    base = F.lit(0).cast("long")
    if first:
        base = F.create_map(*[x for p, n in first.items() for x in (F.lit(p), F.lit(n).cast("long"))])[F.col("_part")]
    return at.withColumn("_row", base + F.col("_in")).drop("_part", "_in"), start
