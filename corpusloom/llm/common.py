"""What the operators of this folder share: the shared folder, written tables, packed rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _set_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_corpusloom_shared", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and all
    runs on one machine (tests), one new temporary folder a context."""
    sc = spark.sparkContext
    base = _set_dir(spark)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._corpusloom_shared = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(base)
    if "://" not in base:  # a path of the cluster's default file system
        path = sc._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = base.replace("file:/", "file:///", 1) if not base.startswith("file:///") else base
    return base.rstrip("/")


#: Rows and bytes of a batch that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 2_500, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for rows of whole texts: they bound a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table that written() made and that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def publish(store, temp: str, path: str) -> None:
    """Give a finished file its name. Another attempt of the task may have done so before: its file holds
    the same bytes and stays."""
    from pyarrow.fs import FileType

    if store.get_file_info(path).type == FileType.NotFound:
        try:
            store.move(temp, path)
            return
        except OSError:
            if store.get_file_info(path).type == FileType.NotFound:
                raise
    store.delete_file(temp)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets for packed rows: a fixed multiple of the session's shuffle partitions, which the user
    sizes to the data as for any other shuffle."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text: two independently seeded 64-bit hashes. Null and empty share one."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(0x5EED), t, F.length(t)).alias("k2")]


def split_by_bucket(bucket: np.ndarray, records: np.ndarray):
    """Yield (bucket, bytes of the records of that bucket)."""
    order = np.argsort(bucket, kind="stable")
    b, r = bucket[order], records[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, int)
    for i, at in enumerate(cuts):
        yield int(b[at]), r[at : cuts[i + 1] if i + 1 < len(cuts) else len(b)].tobytes()
