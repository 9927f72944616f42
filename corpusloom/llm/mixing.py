"""Mixing sources to target weights as a time-varying curriculum (operator 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Weight of a source over training time, by its rank modulo 3: knots (time, weight), linear between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MAX_PASSES = 3
#: Documents in one cumulative-sum cell, on average.
CELL = 4096
#: Rows of the table of sources up to which it is broadcast.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) -> sid, weight, target. Sources in code-point order, null last, weigh
    1, 2, 3, repeating. Water-filling in closed form: sources sorted by cap / weight; a source is capped
    while its cap is below the level that the rest would give it."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        sizes.withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("sid") - 1) % 3 + 1).cast("double"))
        .withColumn("cap", (MAX_PASSES * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("final_level", F.max("level").over(every))
        .withColumn("target", F.when(F.col("ratio") < F.col("level"), F.col("cap")).otherwise(F.least("cap", F.col("final_level") * F.col("weight"))))
        .select("source", "sid", "source_size", "target")
    )


def _inverse(share, schedule):
    """The time at which the integral of a piecewise linear weight schedule reaches share of its whole."""
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((t0, t1, w0, w1, done, area))
        done += area
    out = F.lit(float(schedule[-1][0]))
    for t0, t1, w0, w1, start, area in reversed(pieces):
        rest = F.greatest(share * done - start, F.lit(0.0))
        a = (w1 - w0) / (2 * (t1 - t0))
        step = rest / w0 if a == 0 else (F.sqrt(F.greatest(w0 * w0 + 4 * a * rest, F.lit(0.0))) - w0) / (2 * a)
        out = F.when(share * done < start + area, t0 + step).otherwise(out)
    return out


def curriculum(docs: DataFrame, seed: int = 7, schedules=SCHEDULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, taken,
    passes, positions, and the carried columns.

    A source whose target is q times its size takes each of its documents floor(q) times, then, in an
    order dealt by a seeded hash of doc_id, further documents until the target is met; the last of these
    is cut at the word where the demand ends. passes counts copies, a cut one included. Each copy stands
    at the middle of the stretch of its source's demand that it fills; positions are the training times
    in [0, 1] at which the integral of the source's weight schedule reaches those points.

    Cumulative sizes come in two levels, so no source, however large, meets in one task: cells of hashed
    order are summed, the sums are accumulated over cells, and each cell adds up its own documents.
    Null text has size 0; null sources form a source of their own; empty documents take 0 words in
    floor(q) passes; equal ids are ordered by size; an empty table gives no rows. Reruns agree.
    """
    base = written(docs.select("doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"), *carry), "mix-sizes")
    return place(base, seed, schedules, carry)


def place(base: DataFrame, seed: int = 7, schedules=SCHEDULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """curriculum() from rows doc_id, source, size and what is carried along."""
    sources = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).drop("n")), "mix-sources")
    n_sources, n_docs = sources.count(), base.count()
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    cells = n_docs // CELL + 1
    rows = (
        base.join(side.withColumnRenamed("source", "_s"), base["source"].eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_u", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long"))
        .withColumn("_cell", F.pmod("_u", F.lit(cells)))
    )
    sums = rows.groupBy("sid", "_cell").agg(F.sum("size").alias("_sum"))
    starts = sums.select("sid", "_cell", (F.sum("_sum").over(Window.partitionBy("sid").orderBy("_cell")) - F.col("_sum")).alias("_start"))
    inside = Window.partitionBy("sid", "_cell").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts, ["sid", "_cell"]).withColumn("_before", F.col("_start") + F.sum("size").over(inside) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_PASSES))).otherwise(0).cast("int")
    rest = F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long")
    extra = F.when(F.col("_whole") < MAX_PASSES, F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))).otherwise(0)
    rows = rows.withColumn("_whole", whole).withColumn("_rest", rest).withColumn("_extra", extra.cast("long"))
    share = lambda p: F.when(F.col("target") > 0, F.least(F.lit(1.0), (p * F.col("source_size") + F.col("_before") + F.when(p < F.col("_whole"), F.col("size")).otherwise(F.col("_extra")) / 2) / F.col("target"))).otherwise(0.0)

    def at(p):
        out = _inverse(share(p), schedules[-1])
        for i, schedule in enumerate(schedules[:-1]):
            out = F.when((F.col("sid") - 1) % len(schedules) == i, _inverse(share(p), schedule)).otherwise(out)
        return out

    passes = F.col("_whole") + (F.col("_extra") > 0).cast("int")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"),
        passes.alias("passes"),
        F.when(passes > 0, F.transform(F.sequence(F.lit(0), passes - 1), at)).otherwise(F.array().cast("array<double>")).alias("positions"),
        *carry,
    )


def by_position(placed: DataFrame) -> DataFrame:
    """Rows range-sorted by their first training position, those without one last."""
    return placed.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")
