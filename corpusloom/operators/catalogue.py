"""Books, chapters, items, people with their evaluations, and consensus among verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import label


def books(texts: DataFrame) -> DataFrame:
    """Distinct book names in order; see without_latin for leaving out names in Latin script."""
    return texts.select("book").distinct().orderBy("book")


def without_latin(df: DataFrame, column: str = "book") -> DataFrame:
    return df.where(~F.col(column).rlike("[A-Za-z]"))


def chapters(texts: DataFrame, book: str) -> DataFrame:
    """Chapters of a book by their first number."""
    return texts.where(F.col("book") == book).groupBy("chapter").agg(F.min("number").alias("first_number")).orderBy("first_number")


def items(texts: DataFrame, book: str, chapter: str) -> DataFrame:
    return texts.where((F.col("book") == book) & (F.col("chapter") == chapter)).select("id", "number", F.substring("matn", 1, 150).alias("head")).orderBy("number")


def details(people: DataFrame, evaluations: DataFrame) -> DataFrame:
    """People with their evaluations nested, in order of scholar and verdict."""
    nested = evaluations.groupBy("person").agg(F.sort_array(F.collect_list(F.struct("scholar", "verdict"))).alias("evaluations"))
    return people.join(nested, people["id"] == nested["person"], "left").drop("person").withColumn("evaluations", F.coalesce("evaluations", F.array().cast(nested.schema["evaluations"].dataType)))


def tooltip(people: DataFrame, evaluations: DataFrame, unknown: str = "غير معروف") -> DataFrame:
    """id, name and the first grade there is: the rank's label, the first verdict, or unknown."""
    first = evaluations.groupBy("person").agg(F.min_by("verdict", F.struct("scholar", "verdict")).alias("verdict"))
    ranked = F.when(F.col("rank").isNotNull(), label(F.col("rank"), F.lit(None).cast("string")))
    return people.join(first, people["id"] == first["person"], "left").select("id", "name", F.coalesce(ranked, "verdict", F.lit(unknown)).alias("grade"))


def consensus(evaluations: DataFrame) -> DataFrame:
    """person, praise, blame, other, status (agree, dispute, single, none), evidence."""
    camp = lambda k: F.count_if(F.col("camp") == k)
    out = evaluations.groupBy("person").agg(camp("praise").alias("praise"), camp("blame").alias("blame"), F.count_if(F.col("camp").isNull()).alias("other"))
    sided = F.col("praise") + F.col("blame")
    status = F.when((F.col("praise") > 0) & (F.col("blame") > 0), "dispute").when(sided >= 2, "agree").when(sided == 1, "single").otherwise("none")
    out = out.withColumn("status", status)
    return out.withColumn("evidence", F.when(F.col("status") == "agree", "supported").when(F.col("status") == "none", "insufficient").otherwise("verify"))


def find_people(people: DataFrame, query: str, most: int = 50) -> DataFrame:
    """People (id, name, known_as) whose name or by-name holds the query, the first of them by id."""
    hit = F.coalesce(F.col("name").contains(query), F.lit(False)) | F.coalesce(F.col("known_as").contains(query), F.lit(False))
    return people.where(hit).orderBy("id").limit(most)


def find_in_graph(people: DataFrame, query: Column, most: int = 8) -> DataFrame:
    """id, name, place: people (id, name, norm) whose norm holds all words of the normalised query; first
    those that begin with it, those that hold it whole, those with a word that begins with its first."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    found = people.withColumn("_w", words).where((F.size("_w") > 0) & F.forall("_w", lambda w: F.col("norm").contains(w)))
    head = F.get("_w", F.lit(0))
    place = F.when(F.startswith("norm", query), 0).when(F.col("norm").contains(query), 1).when(F.exists(F.split("norm", " "), lambda x: F.startswith(x, head)), 2).otherwise(3)
    return found.select("id", "name", place.alias("place")).orderBy("place", F.length("name"), "id").limit(most)


def registry_statistics(entries: DataFrame) -> DataFrame:
    """Per source and in all (source null): entries, and the mean numbers of teachers, students and quotes."""
    mean = lambda c: F.avg(F.coalesce(F.array_size(c), F.lit(0))).alias(c)
    return entries.rollup("source").agg(F.count("*").alias("entries"), mean("teachers"), mean("students"), mean("quotes"))


def gathering_summary(sources: DataFrame, findings: DataFrame, low: float = 0.3) -> DataFrame:
    """gid, sources, books, witnesses, findings: texts of a group (gid, text_id, book, is_witness), distinct
    books, witnesses, and findings that are shown (notes below the bound aren't)."""
    own = sources.groupBy("gid").agg(F.countDistinct("text_id").alias("sources"), F.countDistinct("book").alias("books"), F.countDistinct(F.when(F.col("is_witness"), F.col("text_id"))).alias("witnesses"))
    shown = findings.where(~((F.col("severity") == 0) & (F.col("confidence") < low))).groupBy("gid").agg(F.count("*").alias("findings"))
    return own.join(shown, "gid", "left").na.fill(0, ["findings"])
