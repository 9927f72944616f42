"""Sinks: whole tables by staging, one source's rows, upserts, per-book exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_ASIDE = "._old"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_all(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write the tables in the given order to a staging folder, then move each into place: either all are
    replaced or, if a write fails, none. A table's old rows are moved aside until the new ones are in place, so
    that a stop between two moves loses none: see restored(). An empty set of tables does nothing."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    counts, moves = {}, []
    for name, df in tables.items():
        staged = f"{root}/_staging/{name}"
        df.write.mode("overwrite").parquet(staged)
        counts[name] = spark.read.parquet(staged).count()
        moves.append((staged, f"{root}/{name}"))
    for staged, final in moves:
        fs, to = _fs(spark, final)
        aside = _fs(spark, f"{final}{_ASIDE}")[1]
        if fs.exists(to):
            fs.delete(aside, True)
            fs.rename(to, aside)
        if not fs.rename(_fs(spark, staged)[1], to):
            fs.rename(aside, to)
            raise OSError(f"{final} could not be replaced")
        fs.delete(aside, True)
    fs, p = _fs(spark, f"{root}/_staging")
    fs.delete(p, True)
    return counts


def restored(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Bring back the tables that a stopped write_all() had moved aside; the names of those brought back."""
    back = []
    for name in names:
        fs, to = _fs(spark, f"{root}/{name}")
        aside = _fs(spark, f"{root}/{name}{_ASIDE}")[1]
        if fs.exists(aside):
            if not fs.exists(to):
                fs.rename(aside, to)
                back.append(name)
            fs.delete(aside, True)
    return back


def replace_source(df: DataFrame, path: str, source: str) -> None:
    """Replace the rows of one source, leaving those of others: dynamic overwrite of its partition."""
    df.withColumn("source", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def export_chains(texts: DataFrame, links: DataFrame, people: DataFrame, path: str) -> None:
    """One folder of JSON lines a book: texts with their links and names nested in order."""
    p = people.select("id", "name")
    named = links.join(p.select(F.col("id").alias("student"), F.col("name").alias("student_name")), "student", "left").join(p.select(F.col("id").alias("sheikh"), F.col("name").alias("sheikh_name")), "sheikh", "left")
    nested = named.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("step", "student_name", "sheikh_name", "term"))).alias("links"))
    out = texts.join(nested, texts["id"] == nested["text_id"], "left").select("book", "id", "number", F.left("matn", F.lit(400)).alias("head"), "links")
    out.repartition("book").sortWithinPartitions("book", "id").write.mode("overwrite").partitionBy("book").json(path)
