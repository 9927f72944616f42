"""Two books in the same order: entries are aligned between anchors, never against the order."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Words of a key; the least score of a pair; what each entry that is passed over costs; what equal symbols add.
KEY, LEAST, STEP, SYMBOLS = 3, 0.5, 0.002, 0.5


def longest_rise(values: list[int]) -> list[int]:
    """Indexes of a longest strictly rising run of values."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for n, v in enumerate(values):
        p = bisect_left(ends, v)
        ends[p : p + 1], at[p : p + 1] = [v], [n]
        before[n] = at[p - 1] if p else -1
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def score(a: list[str], b: list[str], sa: list[str], sb: list[str]) -> float:
    """The share of leading words that two names have in common, and of their symbols; 0 with another first word."""
    if not a or not b or a[0] != b[0]:
        return 0.0
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = same / max(len(a), len(b))
    return s + SYMBOLS * len(set(sa) & set(sb)) / len(set(sa) | set(sb)) if len(sa) and len(sb) else s


def _key() -> list:
    return ["gid", F.slice("words", 1, KEY).alias("w"), F.array_sort(F.array_distinct("symbols")).alias("s")]


def anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """(gid, i, k): entries whose first words and symbols occur once in either book, thinned out to a longest
    run in which both books have the same order. A task holds two whole numbers for each anchor of a pair of
    books, never an entry."""
    def once(df: DataFrame, to: str) -> DataFrame:
        return df.select(*_key(), "pos").where(F.size("w") + 1 >= KEY).groupBy("gid", "w", "s").agg(F.count("*").alias("n"), F.min("pos").alias(to)).where("n = 1").drop("n")

    def rise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf.iloc[longest_rise(pdf["k"].tolist())]

    return once(left, "i").join(once(right, "k"), ["gid", "w", "s"]).select("gid", "i", "k").groupBy("gid").applyInPandas(rise, "gid long, i long, k long")


def _stretches(df: DataFrame, marks: DataFrame, by: str) -> DataFrame:
    """df's entries between anchors, with the number of anchors before them."""
    w = Window.partitionBy("gid").orderBy("pos", F.desc("mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = df.select("gid", "pos", "words", "symbols", F.lit(0).alias("mark")).unionByName(marks.select("gid", F.col(by).alias("pos"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<string>").alias("symbols"), F.lit(1).alias("mark")))
    numbered = both.withColumn("stretch", F.sum("mark").over(w)).where("mark = 0")
    return numbered.join(marks.select("gid", F.col(by).alias("pos")), ["gid", "pos"], "left_anti").drop("mark")


def _walk(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Left entries in order, each with the best right entry after the last one taken. A right entry so far on
    that even the best score would not do is not looked at."""
    a, b = a.sort_values("pos"), b.sort_values("pos")
    words, symbols, pos = b["words"].tolist(), b["symbols"].tolist(), b["pos"].to_numpy()
    reach = int((1 + SYMBOLS - LEAST) / STEP) + 1
    out, j = [], 0
    for i, w, s in zip(a["pos"], a["words"], a["symbols"]):
        found = [score(list(w), list(words[k]), list(s), list(symbols[k])) - STEP * (k - j) for k in range(j, min(len(b), j + reach))]
        if found and max(found) >= LEAST:
            k = j + int(np.argmax(found))
            out.append((key[0], i, pos[k], max(found)))
            j = k + 1
        if j >= len(b):
            break
    return pd.DataFrame(out, columns=["gid", "i", "k", "score"])


def align_books(left: DataFrame, right: DataFrame) -> DataFrame:
    """(gid, i, k, score) from the entries (gid, pos from 0, words, symbols) of pairs of books: anchors with
    score 2, and between two anchors each left entry in turn with the right entry of best score, less a step
    for each one passed over. Stretches are aligned apart from each other."""
    fill = lambda df: df.select(F.col("gid").alias("gid"), F.col("pos").alias("pos"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("words", "symbols")])
    left, right = fill(left), fill(right)
    found = written(anchors(left, right), "anchors")
    a, b = _stretches(left, found, "i"), _stretches(right, found, "k")
    between = a.groupBy("gid", "stretch").cogroup(b.groupBy("gid", "stretch")).applyInPandas(_walk, "gid long, i long, k long, score double")
    return found.withColumn("score", F.lit(2.0)).union(between)
