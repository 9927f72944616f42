"""Replies of a language model, read as untrusted: only what the texts themselves bear out is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import ARABIC, Lexicon, normalize, quote_grounded

#: Signs that are written above or between letters, and letters that count as others.
SIGNS, SAME_FROM, SAME_TO = "[ؐ-ًؚ-ٰٟۖ-ۭـ]", "ٱىؤئ", "ايءء"
LEVELS = ("direct", "partial", "unrelated")
TIER = r"^T([1-9]|1[0-2])$"


def folded_words(c: Column, lex: Lexicon = ARABIC) -> Column:
    """The text's words in one spelling, between single spaces, with one at both ends."""
    plain = normalize(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), SIGNS, ""), SAME_FROM, SAME_TO), lex)
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(plain, F.lit(f"[{lex.letters}]+"), F.lit(0)), " "), F.lit(" "))


def words_in(quote: Column, text: Column, lex: Lexicon = ARABIC) -> Column:
    """Whether the quote's words stand together in the text."""
    q = folded_words(quote, lex)
    return (F.trim(q) != "") & folded_words(text, lex).contains(q)


def answers(raw: Column) -> Column:
    """array<map<string,string>> of a reply: a JSON array of objects, perhaps within other text; null where
    there is none. Names keep their spelling: see field()."""
    return F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\[.*\])", 1), "array<map<string,string>>")


def field(answer: Column, name: str) -> Column:
    """The value of an answer's field, however the name is capitalised; of several the last."""
    same = F.filter(F.map_entries(answer), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(same, F.lit(-1))["value"]


def judged(replies: DataFrame, rows: DataFrame, levels: tuple[str, ...] = LEVELS, lex: Lexicon = ARABIC) -> DataFrame:
    """request_id, place, id, level, quote, reason for every row (request_id, place from 1, id, matn) of the
    requests: what the reply (request_id, raw) says of it, null where it says nothing that can be trusted.

    A reply is a JSON array of {index, level, quote, reason}, names in any case, perhaps within other text; an
    index given twice, an unknown level and a quote of fewer than three words or one that the text lacks are
    not trusted."""
    said = replies.select("request_id", F.explode(answers(F.col("raw"))).alias("x"))
    said = said.select("request_id", field(F.col("x"), "index").try_cast("int").alias("place"), *[field(F.col("x"), c).alias(c) for c in ("level", "quote", "reason")])
    once = said.withColumn("_n", F.count("*").over(Window.partitionBy("request_id", "place"))).where("_n = 1").drop("_n")
    level = F.lower(F.trim("level"))
    both = rows.join(once, ["request_id", "place"], "left")
    ok = level.isin(*levels) & (F.size(F.split(F.trim(folded_words(F.col("quote"), lex)), " ")) >= 3) & words_in(F.col("quote"), F.col("matn"), lex)
    kept = lambda c: F.when(ok, c)
    return both.select("request_id", "place", "id", kept(level).alias("level"), kept(F.trim("quote")).alias("quote"), kept(F.left(F.trim(F.coalesce("reason", F.lit(""))), F.lit(200))).alias("reason"))


def page_status(judgements: DataFrame) -> DataFrame:
    """request_id, status (reviewed, partial or invalid), answered: what became of each request."""
    n = judgements.groupBy("request_id").agg(F.count("*").alias("n"), F.count("level").alias("answered"))
    return n.select("request_id", F.when(F.col("answered") == F.col("n"), "reviewed").when(F.col("answered") > 0, "partial").otherwise("invalid").alias("status"), "answered")


def tier_status(tier: Column, quote: Column, texts: Column, lex: Lexicon = ARABIC) -> Column:
    """ok where a tier T1 to T12 comes with a quote that one of the texts holds, else unverified."""
    return F.when(F.coalesce(tier.rlike(TIER) & quote_grounded(quote, texts, lex), F.lit(False)), "ok").otherwise("unverified")
