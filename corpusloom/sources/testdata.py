"""The driver's generic tables in the roles of the data model: texts, people, links, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LATIN, normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, number, matn, norm, book, chapter, isnad (its first line)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("number"), F.col("text").alias("matn"), normalize(F.col("text"), LATIN).alias("norm"), F.col("source").alias("book"), F.col("lang").alias("chapter"), F.substring_index("text", "\n", 1).alias("isnad"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, residence, region, rank, birth, death, generation, tadlis_tier, mixed_up, severity."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    i = F.col("s_suppkey")
    return (
        s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
        .select(
            i.alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("residence"), F.col("r_name").alias("region"),
            F.when(i % 13 != 0, (1 + i % 12)).cast("int").alias("rank"),
            (20 + i * 7 % 180).cast("int").alias("birth"), F.when(i % 9 != 0, 70 + i * 11 % 200).cast("int").alias("death"),
            F.when(i % 10 == 0, F.lit(None)).otherwise((1 + i % 8).cast("string")).alias("generation"),
            F.when(i % 4 == 0, 1 + i % 5).cast("int").alias("tadlis_tier"),
            (i % 6 == 0).alias("mixed_up"), F.when(i % 6 == 0, 1 + i % 3).cast("int").alias("severity"), (i % 12 == 0).alias("none_after"),
        )
    )


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's suppliers by dense level of line number, with the term of their first line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.dense_rank().over(w).alias("level"))
    term = F.when(F.col("f") == "R", "heard").when(F.col("f") == "A", "from")
    return li.groupBy(F.col("l_orderkey").alias("text_id"), "level", F.col("l_suppkey").alias("person")).agg(F.min("l_returnflag").alias("f")).select("text_id", "level", "person", term.alias("term"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, step, student, sheikh, term: every pair of people on neighbouring levels of a text."""
    lv = _levels(spark, sf_dir)
    up = lv.select("text_id", (F.col("level") - 1).alias("level"), F.col("person").alias("sheikh"))
    return lv.join(up, ["text_id", "level"]).where("person <> sheikh").select("text_id", F.col("level").alias("step"), F.col("person").alias("student"), "sheikh", "term")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain a text: text_id, step, student, sheikh, term over its lines in order, equal neighbours
    being one person."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", F.lead("l_suppkey").over(w).alias("sheikh"), F.row_number().over(w).alias("n"))
    term = F.when(F.col("l_returnflag") == "R", "heard").when(F.col("l_returnflag") == "A", "from")
    step = F.row_number().over(Window.partitionBy("text_id").orderBy("n"))
    pairs = li.where("sheikh IS NOT NULL AND sheikh <> l_suppkey").select(F.col("l_orderkey").alias("text_id"), "n", F.col("l_suppkey").alias("student"), "sheikh", term.alias("term"))
    return pairs.withColumn("step", step).drop("n")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (teacher, student) that are on record."""
    return chains(spark, sf_dir).where("term = 'heard'").select(F.col("sheikh").alias("teacher"), "student").distinct()


def books_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text_id, book: the market segment stands for the book."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("text_id"), F.col("c_mktsegment").alias("book"))
