"""Readers. Each takes (spark, path) and an explicit schema; the registry picks by path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY = "id BIGINT, name STRING, header STRING, source STRING, verdict STRING, rank INT, fields MAP<STRING,STRING>, teachers ARRAY<BIGINT>, students ARRAY<BIGINT>, quotes ARRAY<STRUCT<critic:STRING,via:STRING,text:STRING>>"
CHAINS = "book STRING, compiler BIGINT, chains ARRAY<STRUCT<text_id:BIGINT,branches:ARRAY<ARRAY<STRUCT<id:BIGINT,verbs:ARRAY<STRING>>>>>>"
RECORDS = "id BIGINT, number BIGINT, kind STRING, arabic STRING, chapter STRING, bab STRING, parts ARRAY<STRUCT<type:STRING,start:INT,end:INT>>"

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: list[tuple[Callable[[str], bool], Reader]] = []


def reader(can: Callable[[str], bool]):
    """Register a reader for the paths that can() accepts; the first registered that accepts is used."""

    def add(f: Reader) -> Reader:
        _READERS.append((can, f))
        return f

    return add


def read(spark: SparkSession, path: str) -> DataFrame:
    for can, f in _READERS:
        if can(path):
            return f(spark, path)
    raise ValueError(f"no reader for {path}")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array or object each; broken files give no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


@reader(lambda p: p.rstrip("/").endswith("registry.json"))
def registry(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, REGISTRY)


@reader(lambda p: "/chains" in p)
def chains(spark: SparkSession, path: str) -> DataFrame:
    """book, compiler, text_id, branches of chain files; files whose names begin with _ are left out."""
    files = json_array(spark, path, CHAINS).select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    return files.where(~F.startswith("file", F.lit("_"))).select("book", "compiler", F.inline("chains"))


@reader(lambda p: p.endswith((".tsv", ".tsv.gz")))
def pages(spark: SparkSession, path: str) -> DataFrame:
    """book, page, body of lines "<book>-<page> TAB <body>"; bad keys go; \\n in bodies is a line end."""
    raw = spark.read.option("sep", "\t").option("quote", "").schema("key STRING, body STRING").csv(path)
    k = F.split("key", "-")
    return raw.select(F.try_element_at(k, F.lit(1)).alias("book"), F.expr("try_cast(try_element_at(split(key, '-'), 2) AS BIGINT)").alias("page"), F.replace(F.col("body"), F.lit("\\n"), F.lit("\n")).alias("body")).where("page IS NOT NULL")


@reader(lambda p: p == "seed")
def seed(spark: SparkSession, path: str) -> DataFrame:
    """A small literal registry for trying things out."""
    rows = [(1, "زيد بن أحمد", None, "seed", "ثقة", 3, {"kunya": "أبو عمر"}, [2], [], [("الناقد", None, "ثقة")]), (2, "عمر بن سعد", None, "seed", "صدوق", 4, {}, [], [1], [])]
    return spark.createDataFrame(rows, REGISTRY)


def numbered_records(body: DataFrame, marker: str = r"(?m)^\s*([0-9٠-٩]+)\s*[-–]\s*") -> DataFrame:
    """book, page, number, text of records that begin with a number and a dash in page bodies."""
    cut = F.split("body", marker.replace("([0-9٠-٩]+)", "[0-9٠-٩]+"))
    numbers = F.regexp_extract_all("body", F.lit(marker), F.lit(1))
    pairs = F.zip_with(numbers, F.slice(cut, 2, F.greatest(F.size(numbers), F.lit(0))), lambda n, t: F.struct(F.translate(n, "٠١٢٣٤٥٦٧٨٩", "0123456789").cast("bigint").alias("number"), F.regexp_replace(t, r"^\s+|\s+$", "").alias("text")))
    return body.select("book", "page", F.inline(F.when(F.size(numbers) > 0, pairs).otherwise(F.array().cast("array<struct<number:bigint,text:string>>"))))


def legacy_lines(spark: SparkSession, path: str, encoding: str = "windows-1256") -> DataFrame:
    """line_no, cells of tab-separated lines in an older code page."""
    lines = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").schema("line STRING").csv(path)
    return lines.select(F.monotonically_increasing_id().alias("line_no"), F.split("line", "\t").alias("cells"))


def forward_filled(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Rows whose nulls take the last value above them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))
