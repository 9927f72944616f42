"""Comparisons of two runs: agreement of chain sets, names gained and lost, evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 4


def agreement(left: DataFrame, right: DataFrame, places: int = PLACES) -> DataFrame:
    """text_id, shift, same, differ, only_left, only_right of two sets of chains (text_id, pos from 0, id):
    over the first places, right moved by -1, 0 or 1, whichever agrees most; ties: the least move, then
    -1. Undecided names (null ids) are absent."""
    a = left.where(F.col("id").isNotNull() & (F.col("pos") < places)).select("text_id", "pos", F.col("id").alias("a"))
    b = right.where(F.col("id").isNotNull()).select("text_id", F.col("pos").alias("p"), F.col("id").alias("b"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"))
    b = b.withColumn("pos", F.col("p") + F.col("shift")).where((F.col("pos") >= 0) & (F.col("pos") < places)).drop("p")
    a = a.withColumn("shift", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    both = a.join(b, ["text_id", "shift", "pos"], "full_outer")
    hit = lambda c: F.count_if(c)
    per = both.groupBy("text_id", "shift").agg(hit(F.col("a") == F.col("b")).alias("same"), hit(F.col("a") != F.col("b")).alias("differ"), hit(F.col("b").isNull()).alias("only_left"), hit(F.col("a").isNull()).alias("only_right"))
    w = Window.partitionBy("text_id").orderBy(F.col("same").desc(), F.abs("shift"), "shift")
    return per.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """text_id, pos, was, now of the names (text_id, pos, id) that two runs resolve differently, and which
    way: gained, lost or changed."""
    a, b = before.select("text_id", "pos", F.col("id").alias("was")), after.select("text_id", "pos", F.col("id").alias("now"))
    both = a.join(b, ["text_id", "pos"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.withColumn("change", F.when(F.col("was").isNull(), "gained").when(F.col("now").isNull(), "lost").otherwise("changed"))


def verification_metrics(cases: DataFrame) -> DataFrame:
    """Per group and in all (grp null): cases, passes, false attributions (a negative that was found),
    abstentions, median latency. cases: grp, expected, got (statuses), ms."""
    negative, found = F.col("expected") == "not-found", F.col("got").isin("exact", "variant")
    return cases.rollup("grp").agg(
        F.count("*").alias("cases"), F.count_if(F.col("expected") == F.col("got")).alias("passed"), F.count_if(negative & found).alias("false_attributions"), F.count_if(~negative & ~found).alias("abstained"), F.median("ms").alias("median_ms")
    )


def by_type(findings: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Findings with the place of their type in a fixed order; unknown types come last."""
    place = F.lit(len(order))
    for k, t in reversed(list(enumerate(order))):
        place = F.when(F.col("type") == t, k).otherwise(place)
    return findings.withColumn("place", place)


#: A finding of the least severity and less confidence is mostly a gap in the data.
SURE = 0.3


def low_confidence(severity: Column, confidence: Column) -> Column:
    return (severity == 0) & (confidence < SURE)


def edge_decorations(findings: DataFrame, all_of_them: bool = False) -> DataFrame:
    """The first finding (severity, confidence) on each edge of findings (gid, student, sheikh, type, ...);
    those of low confidence are left off unless all are asked for."""
    shown = findings if all_of_them else findings.where(~low_confidence(F.col("severity"), F.col("confidence")))
    w = Window.partitionBy("gid", "student", "sheikh").orderBy(F.col("severity").desc(), F.col("confidence").desc(), "type")
    return shown.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def severity_pivot(findings: DataFrame) -> DataFrame:
    """type with a count for each severity, as one row a type."""
    return findings.groupBy("type").pivot("severity", [0, 1, 2]).count().na.fill(0).toDF("type", "notes", "harmless", "harmful")
