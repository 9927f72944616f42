"""Quality rules as a bitmask ledger (operator 3). DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Bit of each rule, in order: a rule keeps its bit for good; new rules are appended.
RULES: tuple[str, ...] = ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words")
#: Versions of the policy: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "long_words"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row and not again for each element of a loop."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that are found twice or more in the array, first ones included.

    Windows are sorted by a 64-bit hash with their start; equal neighbours are compared word by word,
    so a hash collision never counts. Start to next start, each window covers min(WINDOW, gap) words.
    """

    def windows(h):  # hashes of words -> sorted (hash, start)
        span = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.array_sort(F.transform(span, lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))))

    def flagged(w, s):  # words, sorted windows -> sorted starts of those found again
        def same(a, b):
            return (a.h == b.h) & F.coalesce(F.slice(w, a.i + 1, WINDOW) == F.slice(w, b.i + 1, WINDOW), F.lit(False))

        def again(x, k):
            return F.when((k > 0) & same(x, F.get(s, k - 1)), True).when(same(x, F.get(s, k + 1)), True).otherwise(False)

        return F.array_sort(F.transform(F.filter(s, again), lambda x: x.i))

    def covered(p):
        return F.aggregate(p, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc.n + F.least(F.lit(WINDOW), i - acc.last)).alias("n")), lambda acc: acc.n)

    n = let(words, lambda w: let(let(F.transform(w, lambda x: F.xxhash64(x)), windows), lambda s: let(flagged(w, s), covered)))
    return F.when(F.size(words) >= WINDOW, n).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and the measurements of every row, each evaluated once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    out = docs.select("doc_id", text.alias("_t"), F.array_remove(F.split(text, SPACE), "").alias("_w"))
    text, bare = F.col("_t"), F.translate(F.col("_t"), " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    return out.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), "n_repeat_words", F.col("_l.n").alias("n_lines"))


def failures() -> dict[str, Column]:
    """Whether each rule fails, on the columns of measure(). Integer arithmetic only."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 3 * c("word_chars"),
        "duplicate_lines": (c("n_lines") >= 4) & (2 * c("n_dup_lines") > c("n_lines")),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 40 * c("n_words"),
    }


def mask_of(rules: Sequence[str]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the measurements, and fail_bits with bit k set where rule k fails.

    Null text counts as empty; an empty text fails few_words only; other columns of docs are ignored,
    whatever their names; repeated rows are judged one by one; an empty table gives no rows.
    """
    fails = failures()
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits + F.when(fails[rule], F.lit(1 << k)).otherwise(0)
    return measure(docs, text_col).withColumn("fail_bits", bits)


def verdicts(led: DataFrame, version: str = "v1", policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """The ledger with base_failed and kept under a version of the policy; no text is read again."""
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policies["base"]))) != 0).withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of({*policies["base"], *policies[version]}))) == 0)


def ablation(led: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """For each policy and rule in it: documents the rule fails, and documents only it rejects.

    Documents are first counted by fail_bits (at most 2 ** len(RULES) rows), so the rest is tiny."""
    counts = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(v, r, 1 << RULES.index(r), mask_of(rules)) for v, rules in policies.items() for r in rules]
    rules = led.sparkSession.createDataFrame(rows, "version string, rule string, bit long, mask long")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return rules.join(counts, F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, "left").groupBy("version", "rule").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(hit == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))
