"""One person listed by several sources: entries are merged where their names agree and nothing speaks against it.

Entries: id, fallback (boolean), units (name, father, grandfather ... as far as linked), tail (words of the name
after these), nisbas, by_names, sources (arrays), death (text), listed (how many people its lists name), points
(its header only points elsewhere) and fathers (all generations that the header names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: The source in which later namesakes are likely, and how many bearers a rare nisba has at most.
PRIMARY, RARE = "primary", 4
BLOCK = ["kind", "fallback", "u1", "u2", "u3"]
_FACTS = ["units", "tail", "nisbas", "by_names", "death", "sources", "listed", "rare"]


def _sets(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))


def prepared(entries: DataFrame, primary: str = PRIMARY) -> DataFrame:
    """Entries with null arrays empty, blank deaths null, the source primary where there is none, and rare:
    their nisbas that few entries share."""
    clean = entries.select(
        "id", F.coalesce("fallback", F.lit(False)).alias("fallback"), F.coalesce("units", F.array().cast("array<string>")).alias("units"), *[_sets(c).alias(c) for c in ("tail", "nisbas", "by_names")],
        F.expr("nullif(trim(death), '')").alias("death"), F.when(F.size(_sets("sources")) > 0, _sets("sources")).otherwise(F.array(F.lit(primary))).alias("sources"),
        F.coalesce("listed", F.lit(0)).alias("listed"), F.coalesce("points", F.lit(False)).alias("points"), F.coalesce("fathers", F.array().cast("array<string>")).alias("fathers"),
    )
    each = clean.select("id", F.explode("nisbas").alias("n"))
    few = each.groupBy("n").agg(F.count("*").alias("of")).where(F.col("of") <= RARE)
    rare = each.join(few, "n").groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("rare"))
    return clean.join(rare, "id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))


def blocks(entries: DataFrame) -> DataFrame:
    """(block, id, first) of every block that may be one person: by the first three units, or by two units
    and a nisba; at least two members, of which no two share a source. Counting sources leaves such blocks
    with no more members than there are sources, whatever the size of the others."""
    name = [F.get("units", F.lit(0)).alias("u1"), F.get("units", F.lit(1)).alias("u2")]
    three = entries.where(F.size("units") >= 3).select(F.lit(3).alias("kind"), "fallback", *name, F.get("units", F.lit(2)).alias("u3"), "id", "sources")
    two = entries.where(F.size("units") == 2).select(F.lit(2).alias("kind"), "fallback", *name, F.explode("nisbas").alias("u3"), "id", "sources")
    members = three.union(two)
    per = members.select(*BLOCK, "id", F.explode("sources").alias("s")).groupBy(*BLOCK, "s").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    alive = per.groupBy(*BLOCK).agg(F.max("n").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last")).where("n = 1 AND first < last").select(*BLOCK, "first")
    return members.drop("sources").join(alive, BLOCK)


def clash(a: str, b: str) -> Column:
    """Whether what two entries say of their person can't both hold: another great-grandfather, nisbas or
    by-names of which none is common, another death."""
    c = lambda k, x: F.col(f"{k}.{x}")
    apart = lambda x: (F.size(c(a, x)) > 0) & (F.size(c(b, x)) > 0) & ~F.arrays_overlap(c(a, x), c(b, x))
    great = lambda k: F.get(c(k, "units"), F.lit(3))
    return F.coalesce(great(a) != great(b), F.lit(False)) | apart("nisbas") | apart("by_names") | F.coalesce(c(a, "death") != c(b, "death"), F.lit(False))


def supports(a: str, b: str, kind: Column, beside_primary: Column) -> Column:
    """Whether something beyond the block's name says that b is a. Two names need the same rest of the name,
    or a rare nisba; three a common nisba or by-name, or, away from the primary source, the very same units
    or a bare name with which the other one begins."""
    c = lambda k, x: F.col(f"{k}.{x}")
    common = lambda x: F.arrays_overlap(c(a, x), c(b, x))
    begins = lambda s, l: (F.slice(c(l, "units"), 1, F.size(c(s, "units"))) == c(s, "units")) & (F.size(c(s, "tail")) == 0)
    longer = F.size(c(a, "units")) > F.size(c(b, "units"))
    bare = F.when(longer, begins(b, a)).otherwise(begins(a, b))
    rest = (F.size(F.array_except(c(a, "tail"), c(b, "tail"))) == 0) & (F.size(F.array_except(c(b, "tail"), c(a, "tail"))) == 0)
    marked = common("nisbas") | common("by_names")
    return F.when(kind == 2, rest | common("rare")).otherwise(marked | (~beside_primary & ((c(a, "units") == c(b, "units")) | bare)))


def pairs(entries: DataFrame, members: DataFrame, primary: str = PRIMARY) -> DataFrame:
    """(block, first, a, b, clash, supports) of every pair a < b of a block; supports matters where a is first."""
    held = members.join(entries.select("id", F.struct(*_FACTS).alias("e")), "id")
    any_primary = held.groupBy(*BLOCK).agg(F.bool_or(F.array_contains("e.sources", primary)).alias("beside"))
    a = held.select(*BLOCK, "first", F.col("id").alias("a"), F.col("e").alias("x"))
    b = held.select(*BLOCK, F.col("id").alias("b"), F.col("e").alias("y"))
    both = a.join(b, BLOCK).where("a < b").join(any_primary, BLOCK)
    return both.select(*BLOCK, "first", "a", "b", clash("x", "y").alias("clash"), supports("x", "y", F.col("kind"), F.col("beside")).alias("supports"))


def agreed(found: DataFrame) -> DataFrame:
    """(block, first) of the blocks in which no pair clashes and the first member supports every other."""
    ok = found.groupBy(*BLOCK, "first").agg(F.bool_or("clash").alias("bad"), F.bool_and(F.col("supports") | (F.col("a") != F.col("first"))).alias("good"))
    return ok.where("good AND NOT bad").select(*BLOCK, "first")


def _rooted(open_: DataFrame, entries: DataFrame, primary: str) -> DataFrame:
    """(id, root) of the members of settled blocks that are not the root: that with the primary source, else
    with the longest lists, else the first."""
    who = open_.join(entries.select("id", "listed", F.array_contains("sources", primary).alias("p")), "id")
    w = Window.partitionBy(*BLOCK).orderBy(F.col("p").desc(), F.col("listed").desc(), "id")
    return who.withColumn("root", F.first("id").over(w)).where("id <> root").select("id", "root")


def _in_turn(good: DataFrame, entries: DataFrame, primary: str) -> DataFrame:
    """(id, root): agreed blocks of two names, which may share members, taken in the order of their first
    member and nisba; a block counts only if none of its members has gone to another person before. All
    blocks whose members have no earlier one are settled at once, so rounds follow the longest queue for
    one entry, not the number of blocks."""
    open_, gone = written(good, "blocks"), None
    while not open_.isEmpty():
        w = Window.partitionBy("id").orderBy("first", "u3")
        turn = open_.withColumn("turn", F.row_number().over(w) == 1).withColumn("ready", F.bool_and("turn").over(Window.partitionBy(*BLOCK))).drop("turn")
        ready = written(turn, "turns")
        now = ready.where("ready").drop("ready")
        if gone is not None:
            lost = now.join(gone, "id", "left_semi").select(*BLOCK).distinct()
            now = now.join(lost, BLOCK, "left_anti")
        more = _rooted(now, entries, primary)
        gone = written(more if gone is None else gone.union(more), "merged")
        open_ = written(ready.where("NOT ready").drop("ready"), "blocks")
    return good.select("id", F.col("id").alias("root")).limit(0) if gone is None else gone


def _shorter(entries: DataFrame, gone: DataFrame, primary: str) -> DataFrame:
    """(id, root): an entry of two names and the only other one that begins with them, both outside the
    primary source and not yet gone, if nothing clashes, neither points elsewhere and their generations
    are the same words as far as both go."""
    left = entries.where(~F.col("fallback") & (F.size("units") >= 2)).withColumn("u1", F.get("units", F.lit(0))).withColumn("u2", F.get("units", F.lit(1)))
    alone = left.groupBy("u1", "u2").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n = 2 AND lo < hi")
    facts = entries.where(~F.array_contains("sources", primary) & ~F.col("points")).join(gone, "id", "left_anti").select("id", F.struct(*_FACTS, "fathers").alias("e"))
    two = alone.join(facts.select(F.col("id").alias("lo"), F.col("e").alias("x")), "lo").join(facts.select(F.col("id").alias("hi"), F.col("e").alias("y")), "hi")
    short = (F.size("x.units") == 2) | (F.size("y.units") == 2)
    other = F.exists(F.zip_with("x.fathers", "y.fathers", lambda f, g: F.coalesce(f != g, F.lit(False))), lambda z: z)
    found = two.where(short & ~clash("x", "y") & ~other)
    root = F.when(F.col("y.listed") > F.col("x.listed"), F.col("hi")).otherwise(F.col("lo"))
    return found.select(F.when(root == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("id"), root.alias("root"))


def same_person(entries: DataFrame, primary: str = PRIMARY) -> DataFrame:
    """(id, root) of every entry that goes to another one's person; root is an entry that stays."""
    e = written(prepared(entries, primary), "entries")
    members = written(blocks(e), "block-members")
    good = written(members.join(agreed(pairs(e, members, primary)).drop("first"), BLOCK), "agreed")
    gone = written(_rooted(good.where("kind = 3"), e, primary).union(_in_turn(good.where("kind = 2"), e, primary)), "merged")
    up = written(gone.union(_shorter(e, gone, primary)), "merged")
    while True:  # a root may itself have gone to another one
        above = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if up.join(above, "root", "left_semi").isEmpty():
            return up
        up = written(up.join(above, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "merged")


def merged_lists(lists: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, side, name) from lists (id, side, pos, name): each person's own items, then those of the entries
    merged into it (by id) whose name no earlier entry has; place is the new order."""
    w = lists.join(merged, "id", "left").select(F.coalesce("root", "id").alias("owner"), (F.col("root").isNotNull()).alias("late"), "id", "side", "pos", "name")
    first = F.min(F.struct("late", "id")).over(Window.partitionBy("owner", "side", "name"))
    kept = w.withColumn("_f", first).where("_f.late = late AND _f.id = id")
    place = F.row_number().over(Window.partitionBy("owner", "side").orderBy("late", "id", "pos"))
    return kept.select(F.col("owner").alias("id"), "side", place.alias("place"), "name")


def merged_facts(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, aliases, verdict, sources, merged_ids) of the entries that stay, from facts (id, header name,
    aliases, verdict, sources): names under which merged entries are listed are aliases; the first verdict
    and all sources count. A person has as many entries as sources list it."""
    w = facts.join(merged, "id", "left").withColumn("owner", F.coalesce("root", "id")).withColumn("late", F.col("root").isNotNull())
    names = F.when(F.col("late"), F.concat(F.array("header"), F.coalesce("aliases", F.array().cast("array<string>")))).otherwise(F.coalesce("aliases", F.array().cast("array<string>")))
    per = w.select("owner", F.struct("late", "id", names.alias("names"), "verdict", F.coalesce("sources", F.array().cast("array<string>")).alias("sources")).alias("m")).groupBy("owner").agg(F.sort_array(F.collect_list("m")).alias("m"))
    verdicts = F.filter("m.verdict", lambda v: v.isNotNull())
    return per.select(
        F.col("owner").alias("id"), F.array_compact(F.array_distinct(F.flatten("m.names"))).alias("aliases"), F.get(verdicts, F.lit(0)).alias("verdict"),
        F.array_distinct(F.flatten("m.sources")).alias("sources"), F.transform(F.filter("m", lambda x: x["late"]), lambda x: x["id"]).alias("merged_ids"),
    )
