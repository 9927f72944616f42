"""From raw documents to token ids in training order: five stages, each a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import encode_decode
from corpusloom.llm.common import written
from corpusloom.llm.jaccard import best_of_each
from corpusloom.llm.mixing import curriculum
from corpusloom.llm.suffix import remove_repeats
from corpusloom.llm.toxicity import fit, score

#: Columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What counts as a passage: few runs of so many words are shorter than so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 250


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict toxic. Null and empty texts, repeated rows and null
    ids stay; without labels all stay; an empty table gives none; other columns are never read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels), COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id (null ids last); those
    without words (null texts too) all stay, but of repeated rows (same id, same text) one; an empty
    table gives none; other columns are never read."""
    return best_of_each(docs).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages: runs of more than PASSAGE_WORDS words covered by
    strings of PASSAGE_BYTES bytes that also start elsewhere; n_chars follows the text. Null texts come
    out empty; repeated rows, null ids and documents that are left empty stay; an empty table gives none."""
    cut = remove_repeats(docs, ("doc_id", "lang", "source"), with_text=True, length=PASSAGE_BYTES, over_words=PASSAGE_WORDS)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; the copy at which a source's demand
    ends is whole here. Texts without words are never taken, nor are those whose source isn't; null
    sources are a source; of repeated rows (same id, same text) each one's copies are given; an empty
    table gives none."""
    keyed = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k"))
    placed = curriculum(keyed, carry=("_d", "_k"))
    times = placed.where("size > 0").groupBy("_d", "_k").agg(F.flatten(F.collect_list("positions")).alias("_at"))
    one = keyed.dropDuplicates(["_d", "_k"])
    taken = one.join(times, ["_d", "_k"]).select(*COLUMNS, F.explode("_at").alias("_position"))
    return taken.orderBy("_position", "doc_id").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each copy of a document, empty texts,
    repeated rows and null ids included; an empty table gives none."""
    return encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: The classifier, the links and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
