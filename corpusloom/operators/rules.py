"""Rules over chains, each a function to findings, and the grade that follows from them.

chains: gid, text_id, book, step, student, sheikh, term, raised (whether its text is raised to the
source). Findings: gid, type, severity (0 note, 1 harmless, 2 harmful), confidence, people (joined ids),
n_texts. Unknown stays unknown: a person without rank is unsettled, not weak.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import is_ranked, is_successor, tier
from ..functions.text import Lexicon, is_ambiguous, is_explicit

NOTE, HARMLESS, HARMFUL = 0, 1, 2
UNKNOWN, BEFORE, AFTER, BOTH, CONFLICT = range(5)
LIGHT, DISPUTED, SEVERE = 1, 2, 3


def _finding(kind: str, severity: Column, confidence: Column, people: Column, n_texts: Column) -> list[Column]:
    return [F.col("gid"), F.lit(kind).alias("type"), severity.cast("int").alias("severity"), confidence.cast("double").alias("confidence"), people.alias("people"), n_texts.cast("long").alias("n_texts")]


def _pair(a: str, b: str) -> Column:
    return F.concat_ws(",", a, b)


def masking(chains: DataFrame, people: DataFrame, trusted: tuple[str, ...], lex: Lexicon) -> DataFrame:
    """Ambiguous terms of people known to hide their source (tier 3 and up): harmful, unless the pair
    states hearing somewhere in its group or a trusted book carries it."""
    p = people.where("tadlis_tier >= 3").select(F.col("id").alias("student"), "tadlis_tier")
    per = chains.join(p, "student").withColumn("_e", is_explicit(F.col("term"), lex)).withColumn("_a", is_ambiguous(F.col("term"), lex))
    per = per.groupBy("gid", "student", "sheikh").agg(
        F.bool_or("_e").alias("heard"), F.bool_or("_a").alias("vague"), F.bool_or(F.col("_a") & F.col("book").isin(*trusted)).alias("safe"), F.first("tadlis_tier").alias("t"), F.countDistinct(F.when(F.col("_a"), F.col("text_id"))).alias("n")
    ).where("vague")
    severity = F.when(F.col("heard"), NOTE).when(F.col("safe"), HARMLESS).otherwise(HARMFUL)
    confidence = F.when(F.col("heard"), 0.3).when(F.col("safe"), 0.4).when(F.col("t") >= 4, 0.75).otherwise(0.6)
    return per.select(*_finding("masking", severity, confidence, _pair("student", "sheikh"), F.col("n")))


def mixing_up(chains: DataFrame, people: DataFrame, hearings: DataFrame, trusted: tuple[str, ...]) -> DataFrame:
    """Links from people whose memory failed late: by when the student heard, how bad it was, and
    whether all the texts stand in trusted books. hearings: sheikh, student, timing."""
    p = people.where("mixed_up").select(F.col("id").alias("sheikh"), F.coalesce("severity", F.lit(SEVERE)).alias("sev"), F.coalesce("none_after", F.lit(False)).alias("none_after"), tier(F.col("rank"), F.lit(None).cast("string")).alias("t"))
    per = chains.join(p, "sheikh").groupBy("gid", "sheikh", "student").agg(
        F.first("sev").alias("sev"), F.first("none_after").alias("none_after"), F.first("t").alias("t"), F.bool_and(F.col("book").isin(*trusted)).alias("safe"), F.countDistinct("text_id").alias("n")
    )
    per = per.join(hearings, ["sheikh", "student"], "left").withColumn("timing", F.coalesce("timing", F.lit(UNKNOWN)))
    w, s, safe = F.col("timing"), F.col("sev"), F.col("safe")
    either, unknown = w.isin(BOTH, CONFLICT), w == UNKNOWN
    grade = (
        F.when((w == BEFORE) | (unknown & F.col("none_after")), None)
        .when(w == AFTER, F.when((s == SEVERE) & ~safe, F.struct(F.lit(HARMFUL).alias("s"), F.lit(0.8).alias("c"))).when(s.isin(SEVERE, DISPUTED), F.struct(F.lit(HARMLESS).alias("s"), F.lit(0.5).alias("c"))).otherwise(F.struct(F.lit(NOTE).alias("s"), F.lit(0.35).alias("c"))))
        .when(either, F.when(~safe & (s != LIGHT), F.struct(F.lit(NOTE).alias("s"), F.lit(0.4).alias("c"))))
        .when(unknown & ~safe & (s != LIGHT) & ~((s == DISPUTED) & (F.col("t") < 5)), F.struct(F.lit(NOTE).alias("s"), F.when(s == SEVERE, 0.45).otherwise(0.3).alias("c")))
    )
    return per.withColumn("_g", grade).where("_g IS NOT NULL").select(*_finding("mixing_up", F.col("_g.s"), F.col("_g.c"), _pair("sheikh", "student"), F.col("n")))


def hidden_break(chains: DataFrame, people: DataFrame, relations: DataFrame, lex: Lexicon) -> DataFrame:
    """Pairs not on record as teacher and student, though both have records, but for the compiler's own
    link (step 1)."""
    known = relations.select(F.col("teacher").alias("x")).union(relations.select("student")).distinct()
    p = people.select("id", is_ranked(F.col("rank"), F.lit(None).cast("string")).alias("r"))
    per = chains.where("step > 1").groupBy("gid", "student", "sheikh").agg(F.bool_or(is_explicit(F.col("term"), lex)).alias("heard"), F.countDistinct("text_id").alias("n"))
    per = per.join(known.withColumnRenamed("x", "student"), "student", "left_semi").join(known.withColumnRenamed("x", "sheikh"), "sheikh", "left_semi")
    per = per.join(relations.withColumnRenamed("teacher", "sheikh"), ["sheikh", "student"], "left_anti")
    per = per.join(p.select(F.col("id").alias("student"), F.col("r").alias("r1")), "student").join(p.select(F.col("id").alias("sheikh"), F.col("r").alias("r2")), "sheikh")
    confidence = F.when(~F.col("r1") | ~F.col("r2"), 0.2).when(F.col("heard"), 0.25).otherwise(0.45)
    return per.select(*_finding("hidden_break", F.lit(NOTE), confidence, _pair("student", "sheikh"), F.col("n")))


def compare(best_a: Column, n_a: Column, best_b: Column, n_b: Column) -> Column:
    """Which side is stronger: 1 the first, -1 the second, 0 a tie. Two tiers apart, the better tier;
    else more students; else the better tier."""
    by_tier, by_count = F.signum(best_b - best_a).cast("int"), F.signum(n_a - n_b).cast("int")
    return F.when(F.abs(best_a - best_b) >= 2, by_tier).when(by_count != 0, by_count).otherwise(by_tier)


def _sides(per: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """per: keys, student, flag, t, ranked -> keys and, for both values of the flag, best tier, number of
    students, people, whether none is ranked."""
    side = lambda v, c: F.when(F.col(flag) == v, F.col(c))
    aggs = []
    for v, k in ((True, "1"), (False, "0")):
        aggs += [F.min(side(v, "t")).alias("best" + k), F.count(side(v, "student")).alias("n" + k), F.array_join(F.sort_array(F.collect_list(side(v, "student"))), ",").alias("who" + k), F.bool_or(side(v, "ranked")).alias("any" + k)]
    return per.groupBy(*keys).agg(*aggs)


def raised_stopped(chains: DataFrame, people: DataFrame) -> DataFrame:
    """At a split point some students raise the text to the source and some stop short: the weaker side
    is at fault. A student counts if all its chains agree."""
    p = people.select(F.col("id").alias("student"), tier(F.col("rank"), F.lit(None).cast("string")).alias("t"), is_ranked(F.col("rank"), F.lit(None).cast("string")).alias("ranked"))
    per = chains.groupBy("gid", "sheikh", "student").agg(F.bool_and("raised").alias("lo"), F.bool_or("raised").alias("raised")).where("lo = raised").join(p, "student")
    both = _sides(per, ["gid", "sheikh"], "raised").where("n1 > 0 AND n0 > 0")
    c = compare(F.col("best1"), F.col("n1"), F.col("best0"), F.col("n0"))
    return _judged(both, "raised_stopped", c)


def _judged(both: DataFrame, kind: str, c: Column) -> DataFrame:
    both = both.withColumn("_c", c)
    unranked = (F.col("_c") < 0) & ~F.coalesce(F.col("any1"), F.lit(False))
    severity = F.when(unranked, NOTE).when(F.col("_c") < 0, HARMFUL).when(F.col("_c") > 0, HARMLESS).otherwise(NOTE)
    confidence = F.when(unranked, 0.35).when(F.col("_c") < 0, 0.6).when(F.col("_c") > 0, 0.5).otherwise(0.4)
    people = F.when(F.col("_c") < 0, F.col("who1")).when(F.col("_c") > 0, F.col("who0")).otherwise(F.concat_ws("|", "who1", "who0"))
    return both.select(*_finding(kind, severity, confidence, F.concat_ws(":", "sheikh", people), F.col("n1") + F.col("n0")))


def joined_cut(chains: DataFrame, people: DataFrame) -> DataFrame:
    """Chains that end raised at a successor, against those in which that successor names a companion:
    none of the latter is noted; otherwise the weaker side's students are at fault."""
    who = people.select("id", tier(F.col("rank"), F.lit(None).cast("string")).alias("t"), is_ranked(F.col("rank"), F.lit(None).cast("string")).alias("ranked"), (F.col("rank") == 1).alias("companion"), is_successor(F.col("rank"), F.lit(None).cast("string"), F.col("generation")).alias("successor"))
    last = chains.groupBy("gid", "text_id").agg(F.max_by("sheikh", "step").alias("top"), F.max_by("student", "step").alias("below"), F.max("step").alias("n"), F.bool_or("raised").alias("raised"))
    cut = last.join(who.where("successor").select(F.col("id").alias("top")), "top", "left_semi").where("raised").select("gid", F.col("top").alias("sheikh"), "text_id", F.col("below").alias("student"), F.lit(False).alias("joined"))
    up = chains.join(who.where("companion").select(F.col("id").alias("sheikh")), "sheikh", "left_semi").select("gid", "text_id", F.col("student").alias("via"), "step")
    below = chains.select("gid", "text_id", (F.col("step") + 1).alias("step"), "student")
    joined = up.join(below, ["gid", "text_id", "step"]).select("gid", F.col("via").alias("sheikh"), "text_id", "student", F.lit(True).alias("joined"))
    joined = joined.join(cut.select("gid", "sheikh").distinct(), ["gid", "sheikh"], "left_semi")
    alone = cut.join(joined.select("gid", "sheikh").distinct(), ["gid", "sheikh"], "left_anti").groupBy("gid", "sheikh").agg(F.countDistinct("text_id").alias("n"))
    notes = alone.select(*_finding("joined_cut", F.lit(NOTE), F.lit(0.35), F.col("sheikh").cast("string"), F.col("n")))
    per = cut.union(joined).select("gid", "sheikh", "student", "joined").distinct().join(who.select(F.col("id").alias("student"), "t", "ranked"), "student")
    both = _sides(per, ["gid", "sheikh"], "joined").where("n1 > 0 AND n0 > 0")
    return notes.unionByName(_judged(both, "joined_cut", compare(F.col("best1"), F.col("n1"), F.col("best0"), F.col("n0"))))


def analyse(*findings: DataFrame) -> DataFrame:
    """All rules' findings with their order: severity, confidence, then the rules' own."""
    out = reduce(DataFrame.unionByName, [f.withColumn("rule", F.lit(k)) for k, f in enumerate(findings)])
    return out.orderBy("gid", F.col("severity").desc(), F.col("confidence").desc(), "rule", "people")


def counts(findings: DataFrame) -> DataFrame:
    """gid, harmful, harmless, notes, has_harmful, low_confidence."""
    is_ = lambda k: F.count_if(F.col("severity") == k)
    return findings.groupBy("gid").agg(is_(HARMFUL).alias("harmful"), is_(HARMLESS).alias("harmless"), is_(NOTE).alias("notes"), F.bool_or(F.col("severity") == HARMFUL).alias("has_harmful"), F.count_if((F.col("severity") == NOTE) & (F.col("confidence") < 0.3)).alias("low_confidence"))


#: The grades.
SOUND, GOOD, GOOD_BY_OTHERS, WEAK, FORGED, UNSETTLED, NOBODY = "صحيح", "حسن", "حسن لغيره", "ضعيف", "موضوع / متروك", "غير محرر", "مجهول"
WEAK_BY_DEFECT = "ضعيف (معلول)"


def structural_grade(weakest: DataFrame, groups: DataFrame) -> DataFrame:
    """gid, grade, best, routes from each chain's weakest link (text_id, weakest, tier, unrated)."""
    own = weakest.join(groups.select("text_id", "gid"), "text_id")
    judged = F.col("tier").isNotNull() & ((F.col("unrated") == 0) | (F.col("tier") >= 6))
    open_ = (F.col("unrated") > 0) & ~F.coalesce(F.col("tier") >= 6, F.lit(False))
    g = own.groupBy("gid").agg(F.min(F.when(judged, F.col("tier"))).alias("best"), F.count_if(judged).alias("routes"), F.count_if(open_).alias("open"), F.countDistinct(F.when(judged & F.col("tier").between(6, 8), F.col("weakest"))).alias("weak"))
    b = F.col("best")
    out = (
        F.when((F.col("routes") == 0) & (F.col("open") > 0), UNSETTLED).when(F.col("routes") == 0, NOBODY).when(b <= 3, SOUND).when(b <= 5, GOOD)
        .when(b <= 8, F.when(F.col("open") > 0, UNSETTLED).when(F.col("weak") >= 2, GOOD_BY_OTHERS).otherwise(WEAK)).otherwise(FORGED)
    )
    return g.select("gid", out.alias("grade"), "best", "routes")


def with_defects(grades: DataFrame, sources: DataFrame) -> DataFrame:
    """grades with the override: sources (gid, text_id, harmful) all harmful: weak by defect, unless
    already forged; some: a warning."""
    s = sources.groupBy("gid").agg(F.bool_and("harmful").alias("every"), F.bool_or("harmful").alias("some"))
    out = grades.join(s, "gid", "left")
    new = F.when(F.col("every") & (F.col("grade") != FORGED), WEAK_BY_DEFECT).otherwise(F.col("grade"))
    return out.select("gid", new.alias("grade"), F.coalesce(F.col("some") & ~F.col("every"), F.lit(False)).alias("warned"))


def on_routes(chains: DataFrame, witnesses: DataFrame) -> DataFrame:
    """The chains that rules run on: those of witnesses (gid, text_id, is_witness) are other reports."""
    return chains.join(witnesses.where("is_witness").select("gid", "text_id"), ["gid", "text_id"], "left_anti")


def report(chains: DataFrame, people: DataFrame, relations: DataFrame, hearings: DataFrame, witnesses: DataFrame, trusted: tuple[str, ...], lex: Lexicon, *more: DataFrame) -> DataFrame:
    """Findings of all rules over the routes of every group, in their order; more: findings of rules that
    need the texts themselves, such as variation.text_at_split."""
    own = on_routes(chains, witnesses)
    return analyse(masking(own, people, trusted, lex), mixing_up(own, people, hearings, trusted), hidden_break(own, people, relations, lex), *more, raised_stopped(own, people), joined_cut(own, people))
