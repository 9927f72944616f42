"""Pages of search results judged by a language model that the caller brings: what is asked, what is believed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import LEVELS, answers, judged
from ..functions.text import ARABIC, Lexicon, query_terms
from ..shared import written

#: Ids of a request, rows of a prompt, answers kept for later requests, and the window that a prompt shows.
PAGE, CHUNK, KEPT, WINDOW, BEFORE = 50, 20, 5000, 350, 80


def page(requests: DataFrame, texts: DataFrame, lex: Lexicon = ARABIC, most: int = PAGE) -> DataFrame:
    """(request_id, query_key, place, id, matn, norm) of requests (request_id, query, ids array): the first
    different ids of each, in their order; query_key is its terms. A request without terms has none."""
    key = F.array_join(query_terms(F.col("query"), lex), " ")
    ids = F.slice(F.array_distinct("ids"), 1, most)
    rows = requests.select("request_id", key.alias("query_key"), F.posexplode(ids).alias("place", "id")).where("query_key <> ''")
    return rows.withColumn("place", F.col("place") + 1).join(texts.select("id", "matn", "norm"), "id", "left")


def chunked(rows: DataFrame, known: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows that have a text and no known answer (query_key, id), with chunk and line, their place in its prompt."""
    left = rows.where("matn IS NOT NULL").join(known.select("query_key", "id"), ["query_key", "id"], "left_anti")
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("place"))
    return left.withColumn("_n", n - 1).withColumn("chunk", F.floor(F.col("_n") / chunk).cast("int")).withColumn("line", (F.col("_n") % chunk + 1).cast("int")).drop("_n")


def shown(matn: Column, at: Column, width: int = WINDOW, before: int = BEFORE) -> Column:
    """What a prompt shows of a text: a stretch from a little before the place at, marked where it is cut."""
    begin = F.greatest(at - before, F.lit(0))
    cut = F.regexp_replace(matn.substr(begin + 1, F.lit(width)), r"(?U)^\s+|\s+$", "")
    return F.concat(F.when(begin > 0, "… ").otherwise(""), cut, F.when(begin + width < F.length(matn), " …").otherwise(""))


def prompts(asked: DataFrame, at: Column, width: int = WINDOW, before: int = BEFORE) -> DataFrame:
    """(request_id, chunk, query_key, lines): the numbered lines of each prompt; at is a column of asked."""
    line = F.struct("line", F.concat(F.lit("["), F.col("line").cast("string"), F.lit("] "), shown(F.col("matn"), at, width, before)).alias("s"))
    return asked.groupBy("request_id", "chunk", "query_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("lines"))


def judge_pages(
    requests: DataFrame, texts: DataFrame, known: DataFrame, judge: Callable[[DataFrame], DataFrame], at: Column | None = None, lex: Lexicon = ARABIC, levels: tuple[str, ...] = LEVELS, most: int = PAGE, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, status, fresh). judge turns prompts (request_id, chunk, query_key, lines) into replies
    (request_id, chunk, raw, failure): failure is null, 'timeout' or another reason.

    items: request_id, place, id, level, quote, reason, cached for every id of a request, level null where
    nothing can be trusted. status: request_id, status, chunks, failed: invalid (no terms or ids), reviewed,
    partial, timeout or unavailable; a reply that can't be read is a failed chunk. fresh: new answers for known
    (query_key, id, level, quote, reason), which the caller hands in again: see kept()."""
    rows = written(page(requests, texts, lex, most), "judge-page")
    asked = written(chunked(rows, known, chunk), "judge-asked")
    replies = written(judge(prompts(asked, F.lit(0) if at is None else at)).select("request_id", "chunk", "raw", "failure"), "judge-replies")
    name = F.concat_ws("\x1f", "request_id", "chunk")
    good = replies.where("failure IS NULL").select(name.alias("request_id"), "raw")
    lines = asked.select(name.alias("request_id"), F.col("line").alias("place"), "id", "matn")
    said = judged(good, lines, levels, lex).withColumnRenamed("place", "line")
    new = asked.withColumn("_r", name).join(said.select(F.col("request_id").alias("_r"), "line", "level", "quote", "reason"), ["_r", "line"], "left").select("request_id", "query_key", "place", "id", "level", "quote", "reason")
    new = written(new, "judge-new")
    old = rows.join(known.select("query_key", "id", "level", "quote", "reason"), ["query_key", "id"])
    answered = old.select("request_id", "place", "level", "quote", "reason", F.lit(True).alias("cached")).union(new.where("level IS NOT NULL").select("request_id", "place", "level", "quote", "reason", F.lit(False)))
    items = rows.select("request_id", "place", "id").join(answered, ["request_id", "place"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    bad = F.col("failure").isNotNull() | answers(F.col("raw")).isNull() | F.col("raw").isNull()
    all_chunks = asked.select("request_id", "chunk").distinct().join(replies, ["request_id", "chunk"], "left").withColumn("bad", bad)
    per = all_chunks.groupBy("request_id").agg(F.count("*").alias("chunks"), F.count_if("bad").alias("failed"), F.bool_or(F.coalesce(F.col("failure") == "timeout", F.lit(False))).alias("late"))
    valid = rows.select("request_id").distinct().withColumn("valid", F.lit(True))
    both = requests.select("request_id").join(valid, "request_id", "left").join(per, "request_id", "left").na.fill(0, ["chunks", "failed"])
    state = (
        F.when(F.col("valid").isNull(), "invalid").when(F.col("failed") == 0, "reviewed").when(F.col("failed") < F.col("chunks"), "partial")
        .when(F.col("late"), "timeout").otherwise("unavailable")
    )
    fresh = new.where("level IS NOT NULL").select("query_key", "id", "level", "quote", "reason").dropDuplicates(["query_key", "id"])
    return items, both.select("request_id", state.alias("status"), "chunks", "failed"), fresh


def kept(known: DataFrame, fresh: DataFrame, most: int = KEPT) -> DataFrame:
    """Answers to keep: all, as long as there are no more than most; beyond, only the new ones."""
    n = known.limit(most + 1).count()
    return fresh if n > most else known.join(fresh.select("query_key", "id"), ["query_key", "id"], "left_anti").select("query_key", "id", "level", "quote", "reason").union(fresh)
