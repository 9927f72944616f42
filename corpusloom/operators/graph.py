"""Transmission graphs: trees, merged graphs, paths, split points. links: text_id, step, student, sheikh, term."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import grade
from ..functions.places import nothing_in_common, places_of
from ..functions.text import ARABIC, Lexicon

PATHS = 16


def tree(links: DataFrame, people: DataFrame) -> DataFrame:
    """text_id, step, person, parent, grade: the students of step 1 as roots (step 0, no parent), then
    recursively the sheikhs of each person at the next step. Paths that meet again repeat their rows."""
    spark = links.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    walk = spark.sql(
        """
        WITH RECURSIVE walk(text_id, step, person, parent) AS (
          SELECT DISTINCT text_id, 0 AS step, student AS person, CAST(NULL AS BIGINT) AS parent FROM {links} WHERE step = 1
          UNION ALL
          SELECT w.text_id, w.step + 1, l.sheikh, w.person FROM walk w JOIN {links} l ON l.text_id = w.text_id AND l.step = w.step + 1 AND l.student = w.person
        ) SELECT * FROM walk
        """,
        links=links.select("text_id", F.col("step").cast("int").alias("step"), F.col("student").cast("bigint").alias("student"), F.col("sheikh").cast("bigint").alias("sheikh")),
    )
    p = people.select(F.col("id").alias("person"), grade(F.lit(None).cast("string"), F.col("rank")).alias("grade"))
    return walk.join(p, "person", "left").select("text_id", "step", "person", "parent", "grade")


def anomalies(links: DataFrame, people: DataFrame, regions: dict[str, str], cities: tuple[str, ...] = (), noise: tuple[str, ...] = (), lex: Lexicon = ARABIC) -> DataFrame:
    """Links above the compiler's own (step 1): whether the student was born after the sheikh died, and
    if not, whether the two share neither a place nor a region, both being known. The places of a person are
    those that residence and death_place name; regions gives those of places in normal form."""
    at = places_of(F.concat_ws("،", "residence", "death_place"), cities, noise, lex)
    p = people.withColumn("_at", at)
    s = p.select(F.col("id").alias("student"), F.col("birth").alias("_birth"), F.col("_at").alias("_p1"))
    t = p.select(F.col("id").alias("sheikh"), F.col("death").alias("_death"), F.col("_at").alias("_p2"))
    late = F.coalesce(F.col("_birth") > F.col("_death"), F.lit(False))
    apart = nothing_in_common(F.col("_p1"), F.col("_p2"), regions)
    return links.where("step > 1").join(s, "student").join(t, "sheikh").select("text_id", "step", "student", "sheikh", late.alias("anachronism"), (~late & apart).alias("apart"))


def _rows(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Attribution rows (gid, text_id, book, person, student, step): every compiler once a text at step 0,
    every sheikh with the student that is its parent."""
    own = links.join(groups, "text_id")
    base = own.where("step = 1").select("gid", "text_id", "book", F.col("student").alias("person"), F.lit(None).cast("bigint").alias("student"), F.lit(0).alias("step")).distinct()
    return base.unionByName(own.select("gid", "text_id", "book", F.col("sheikh").alias("person"), "student", F.col("step").cast("int").alias("step")))


def _valid(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Edges that can be drawn: no loops, no companion who hears from one who isn't."""
    c = people.select("id", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("c"))
    s, t = c.select(F.col("id").alias("student"), F.col("c").alias("_cs")), c.select(F.col("id").alias("person"), F.col("c").alias("_ct"))
    return rows.where("step > 0 AND student IS NOT NULL AND student <> person").join(s, "student").join(t, "person").where("NOT (_cs AND NOT _ct)").drop("_cs", "_ct")


def merged_nodes(links: DataFrame, groups: DataFrame, people: DataFrame) -> DataFrame:
    """gid, person, step, n_sources, books, parent: one node a person and group of texts. Attribution is
    by the rows of step 0 where the person is a compiler there; parent where there is exactly one."""
    rows = _rows(links, groups)
    lowest = Window.partitionBy("gid", "person")
    counted = rows.withColumn("_low", F.min("step").over(lowest)).where("_low > 0 OR step = 0")
    nodes = counted.groupBy("gid", "person").agg(F.min("step").alias("step"), F.countDistinct("text_id").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("book")), ",").alias("books"))
    one = _valid(rows, people).groupBy("gid", "person").agg(F.countDistinct("student").alias("_n"), F.min("student").alias("_s"))
    return nodes.join(one, ["gid", "person"], "left").select("gid", "person", "step", "n_sources", "books", F.when((F.col("step") > 0) & (F.col("_n") == 1), F.col("_s")).alias("parent"))


def merged_edges(links: DataFrame, groups: DataFrame, people: DataFrame) -> DataFrame:
    """gid, sheikh, student, step, n_sources, books: the edges that a node's parent doesn't hold, for
    sheikhs with several students or who are compilers themselves."""
    rows = _rows(links, groups)
    lowest = rows.groupBy("gid", "person").agg(F.min("step").alias("_low"))
    edges = _valid(rows, people).groupBy("gid", "person", "student").agg(
        F.greatest(F.lit(1), F.min("step")).alias("step"), F.countDistinct("text_id").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("book")), ",").alias("books")
    )
    many = Window.partitionBy("gid", "person")
    return edges.withColumn("_n", F.count("*").over(many)).join(lowest, ["gid", "person"]).where("_n > 1 OR _low = 0").select("gid", F.col("person").alias("sheikh"), "student", "step", "n_sources", "books")


def _paths(rows: list[tuple[int, int, int]], most: int | None) -> list[list[int]]:
    """Paths from each link of step 1 (step, student, sheikh), depth first: on to the nearest later step
    at which the last sheikh is a student of someone not yet met."""
    by: dict[int, list[tuple[int, int]]] = {}
    for step, student, sheikh in sorted(rows):
        by.setdefault(student, []).append((step, sheikh))
    out: dict[tuple[int, ...], None] = {}
    stack = [(step, (student, sheikh)) for step, student, sheikh in sorted(rows, reverse=True) if step == 1]
    while stack and (most is None or len(out) < most):
        step, path = stack.pop()
        ahead = [(s, x) for s, x in by.get(path[-1], ()) if s > step and x not in path]
        nearest = min((s for s, _ in ahead), default=None)
        if nearest is None:
            out.setdefault(path)
        else:
            stack += [(s, (*path, x)) for s, x in sorted(ahead, reverse=True) if s == nearest]
    return [list(p) for p in out]


def paths(links: DataFrame, most: int | None = PATHS) -> DataFrame:
    """text_id, path (people joined by >): each text's paths, at most so many. A text's links, the names of
    one record, are nested first, so that a batch of texts is one call."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([[">".join(map(str, p)) for p in _paths([(x["step"], x["student"], x["sheikh"]) for x in r], most)] for r in rows])

    nested = links.groupBy("text_id").agg(F.collect_set(F.struct("step", "student", "sheikh")).alias("rows"))
    return nested.select("text_id", F.explode(run("rows")).alias("path"))


def reachable(links: DataFrame, focus: DataFrame) -> DataFrame:
    """(text_id, person): all sheikhs above the focus (text_id, person) and all students below it."""
    spark = links.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    e = links.select("text_id", F.col("step").cast("int").alias("step"), F.col("student").cast("bigint").alias("student"), F.col("sheikh").cast("bigint").alias("sheikh"))
    f = focus.select("text_id", F.col("person").cast("bigint").alias("person"))
    sql = """
        WITH RECURSIVE go(text_id, person, step) AS (
          SELECT f.text_id, l.{far}, l.step FROM {f} f JOIN {e} l ON l.text_id = f.text_id AND l.{near} = f.person
          UNION ALL
          SELECT g.text_id, l.{far}, l.step FROM go g JOIN {e} l ON l.text_id = g.text_id AND l.{near} = g.person AND l.step = g.step {move} 1
        ) SELECT DISTINCT text_id, person FROM go
        """
    up = spark.sql(sql.replace("{far}", "sheikh").replace("{near}", "student").replace("{move}", "+"), e=e, f=f)
    down = spark.sql(sql.replace("{far}", "student").replace("{near}", "sheikh").replace("{move}", "-"), e=e, f=f)
    return up.union(down).union(f).distinct()


def split_points(links: DataFrame, groups: DataFrame) -> DataFrame:
    """gid, madar, n_students, n_texts, students: people from whom two students or more transmit."""
    own = links.join(groups.select("text_id", "gid"), "text_id")
    out = own.groupBy("gid", F.col("sheikh").alias("madar")).agg(F.countDistinct("student").alias("n_students"), F.countDistinct("text_id").alias("n_texts"), F.array_join(F.sort_array(F.collect_set("student")), ",").alias("students"))
    return out.where("n_students >= 2")


def tops(links: DataFrame) -> DataFrame:
    """text_id, top: the last sheikh of a single chain."""
    return links.groupBy("text_id").agg(F.max_by("sheikh", "step").alias("top"))


def main_companion(links: DataFrame, groups: DataFrame, people: DataFrame) -> DataFrame:
    """gid, main, n: the companion that most chains of a group end at, on a tie that of the earliest."""
    c = people.where("rank = 1").select(F.col("id").alias("top"))
    per = tops(links).join(c, "top", "left_semi").join(groups.select("text_id", "gid"), "text_id").groupBy("gid", "top").agg(F.count("*").alias("n"), F.min("text_id").alias("_first"))
    return per.groupBy("gid").agg(F.max_by("top", F.struct(F.col("n"), -F.col("_first"))).alias("main"), F.max("n").alias("n"))


def witnesses(links: DataFrame, groups: DataFrame, people: DataFrame) -> DataFrame:
    """gid, text_id, top, is_witness: whether a chain ends at another companion than the main one."""
    c = people.where("rank = 1").select(F.col("id").alias("top"), F.lit(True).alias("_c"))
    main = main_companion(links, groups, people).select("gid", "main")
    own = tops(links).join(groups.select("text_id", "gid"), "text_id").join(main, "gid", "left").join(c, "top", "left")
    return own.select("gid", "text_id", "top", F.coalesce(F.col("_c") & (F.col("top") != F.col("main")), F.lit(False)).alias("is_witness"))


def weakest(links: DataFrame, people: DataFrame) -> DataFrame:
    """text_id, weakest, tier, unrated: the ranked person of the worst tier above the compiler, on a tie
    the nearest to it, and how many there have no rank."""
    p = people.select(F.col("id").alias("sheikh"), "rank")
    own = links.join(p, "sheikh")
    best = F.when(F.col("rank").isNotNull(), F.struct(F.col("rank"), -F.col("step")))
    return own.groupBy("text_id").agg(F.max_by("sheikh", best).alias("weakest"), F.max("rank").alias("tier"), F.count_if(F.col("rank").isNull()).alias("unrated"))


def edge_flags(edges: DataFrame) -> DataFrame:
    """One row a (sheikh, student): any flag of its rows, all their books."""
    return edges.groupBy("sheikh", "student").agg(F.bool_or("flag").alias("flag"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("books")))), ",").alias("books"))


def by_companion(nodes: DataFrame) -> DataFrame:
    """gid, text_id, companion, is_witness from merged nodes (gid, person, step, texts array): each text's
    companion is who stands at its highest step (the one of most such nodes, then the least); those of another
    companion than most texts of the group have are witnesses, on a tie the first text's counts."""
    own = nodes.select("gid", "person", "step", F.explode("texts").alias("text_id"))
    tips = own.withColumn("_top", F.max("step").over(Window.partitionBy("gid", "text_id"))).where("step = _top")
    per = tips.groupBy("gid", "text_id", "person").agg(F.count("*").alias("n")).groupBy("gid", "text_id").agg(F.max_by("person", F.struct(F.col("n"), -F.col("person"))).alias("companion"))
    votes = per.groupBy("gid", "companion").agg(F.count("*").alias("n"), F.min("text_id").alias("first"))
    main = votes.groupBy("gid").agg(F.max_by("companion", F.struct(F.col("n"), -F.col("first"))).alias("main"))
    return per.join(main, "gid").select("gid", "text_id", "companion", (F.col("companion") != F.col("main")).alias("is_witness"))


def mark_variants(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """edges (gid, step, texts array, ...) with varies: whether an edge of step 1 belongs to a text among
    variants (gid, text_id)."""
    odd = variants.groupBy("gid").agg(F.collect_set("text_id").alias("_odd"))
    return edges.join(odd, "gid", "left").withColumn("varies", F.coalesce((F.col("step") == 1) & F.arrays_overlap("texts", "_odd"), F.lit(False))).drop("_odd")


def gathered(given: DataFrame, related: DataFrame, most: int = 30) -> DataFrame:
    """(gid, text_id): each given text (id) and those related to it (of, id), distinct, at most so many."""
    both = given.select(F.col("id").alias("gid"), F.col("id").alias("text_id"), F.lit(0).alias("o")).union(related.select("of", "id", F.lit(1)))
    first = both.groupBy("gid", "text_id").agg(F.min("o").alias("o"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("gid").orderBy("o", "text_id"))).where(F.col("_n") <= most).select("gid", "text_id")


def reference_cards(sources: DataFrame) -> DataFrame:
    """gid, book, numbers (sorted, distinct), texts: one card a book of a group's sources (gid, text_id, book,
    number)."""
    return sources.groupBy("gid", "book").agg(F.sort_array(F.collect_set("number")).alias("numbers"), F.countDistinct("text_id").alias("texts"))
