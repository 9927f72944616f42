"""Tables that an operator passes on to itself: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all runs on one machine (tests), one new temporary
    folder a context."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_corpusloom_tables", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._corpusloom_tables = "file://" + tempfile.mkdtemp(prefix="corpusloom-tables-")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
