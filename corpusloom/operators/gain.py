"""The order in which books add most: greedy cover with gains that are refreshed only where they may lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Books whose gains are refreshed at once.
FRESH = 16
_OUT = "place int, book string, added long, total long"


def order_of_gain(hits: DataFrame, first: str | None = None, fresh: int = FRESH) -> DataFrame:
    """place, book, added, total: books in the order in which each adds most occurrences of names that none
    before it has, ties by book, until nothing is added. hits: book, name, n (occurrences of the name in all,
    the same for each book); first: a book that is in use already, whose names count as had.

    A book's gain only falls as others are taken, so what it was is a bound on what it is: only the books whose
    bound may lead are counted anew, over hits that are still open. The driver holds two numbers a book."""
    spark = hits.sparkSession
    open_ = written(hits.where("book IS NOT NULL AND name IS NOT NULL AND n > 0").groupBy("book", "name").agg(F.max("n").alias("n")), "gain-hits")
    if first is not None:
        open_ = _without(open_, first)
    gains = open_.groupBy("book").agg(F.sum("n").alias("n"))
    bound = {r.book: r.n for r in gains.collect()}
    exact, out, total = set(bound), [], 0
    while bound:
        lead = sorted(bound, key=lambda b: (-bound[b], b))
        if lead[0] not in exact:
            stale = [b for b in lead if b not in exact][:fresh]
            now = {r.book: r.n for r in open_.where(F.col("book").isin(stale)).groupBy("book").agg(F.sum("n").alias("n")).collect()}
            for b in stale:
                if b in now:
                    bound[b] = now[b]
                    exact.add(b)
                else:
                    del bound[b]
            continue
        best = lead[0]
        total += bound[best]
        out.append((len(out) + 1, best, bound.pop(best), total))
        open_, exact = _without(open_, best), set()
    return spark.createDataFrame(out, _OUT)


def _without(open_: DataFrame, book: str) -> DataFrame:
    """The hits whose names the book doesn't have."""
    own = open_.where(F.col("book") == book).select("name")
    return written(open_.join(own, "name", "left_anti"), "gain-hits")
