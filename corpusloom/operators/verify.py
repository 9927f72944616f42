"""Batch verification of quoted passages against a corpus by shared word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Lexicon, bigrams, score_tokens, status, unmatched_negation, unmatched_words

LEAST, BEST = 0.3, 5
#: What can be verified: so many words at least, so many characters at most.
FEWEST_WORDS, MOST_CHARS = 3, 600
#: Word pairs of all inputs up to which they are sent to the corpus; more are joined by shuffling.
SENT = 500_000


def _pairs(c: Column, lex: Lexicon) -> Column:
    return bigrams(score_tokens(c, lex, stem=True))


def containments(inputs: DataFrame, texts: DataFrame, lex: Lexicon, least: float = LEAST) -> DataFrame:
    """(input_id, id, similarity): the share of an input's pairs of stems that a text holds, from least up.
    inputs: input_id, text; texts: id, matn.

    One inverted join on the pairs in place of a search an input, so that no retrieval step can miss a text.
    Where the inputs' pairs are few the corpus stays in place and only counts of hits are shuffled."""
    given = inputs.select("input_id", _pairs(F.col("text"), lex).alias("b")).withColumn("n", F.size("b")).where("n > 0")
    left = given.select("input_id", "n", F.explode("b").alias("pair"))
    left = F.broadcast(left) if (given.agg(F.sum("n")).first()[0] or 0) <= SENT else left
    right = texts.select("id", F.explode(_pairs(F.col("matn"), lex)).alias("pair"))
    hits = right.join(left, "pair").groupBy("input_id", "id").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return hits.select("input_id", "id", (F.col("k") / F.col("n")).alias("s")).where(F.col("s") >= least).select("input_id", "id", F.bround("s", 3).alias("similarity"))


def matches(inputs: DataFrame, texts: DataFrame, lex: Lexicon, most: int = BEST) -> DataFrame:
    """The best texts of every input: input_id, id, similarity, place; of equal ones the shortest, then the
    least id."""
    found = containments(inputs, texts, lex).join(texts.select("id", F.length("matn").alias("_len")), "id")
    w = Window.partitionBy("input_id").orderBy(F.col("similarity").desc(), "_len", "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("input_id", "id", "similarity", "place")


def verdicts(inputs: DataFrame, texts: DataFrame, lex: Lexicon) -> DataFrame:
    """input_id, similarity, status, best, unmatched, negated for every input: its best text, the words
    it lacks, and whether the input denies what the text doesn't.

    An input that denies is not found, however like the text it is; without a match it isn't found either;
    one that is too short or too long isn't looked up (invalid)."""
    valid = (F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")) >= FEWEST_WORDS) & (F.length("text") <= MOST_CHARS)
    top = matches(inputs.where(valid), texts, lex, 1).select("input_id", F.col("id").alias("best"), "similarity")
    out = inputs.join(top, "input_id", "left").join(texts.select(F.col("id").alias("best"), "matn"), "best", "left")
    negated = F.coalesce(unmatched_negation(score_tokens(F.col("text"), lex), score_tokens(F.col("matn"), lex), lex), F.lit(False)) & F.col("best").isNotNull()
    s = F.coalesce("similarity", F.lit(0.0))
    missing = F.when(F.col("best").isNotNull(), F.array_join(unmatched_words(F.col("text"), F.col("matn"), lex), ","))
    verdict = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(negated, "not-found").otherwise(status(s))
    return out.select("input_id", s.alias("similarity"), verdict.alias("status"), "best", missing.alias("unmatched"), negated.alias("negated"))
