"""Queries of linking over the driver's tables, each with its SQL beside it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking
from ..sources import testdata as td
from .oracles import CHAINS, PEOPLE, RELATIONS

Query = Callable[[SparkSession, str], DataFrame]
STARTS = {"NATION_1": "Supplier#00000000", "NATION_7": "Supplier#0000000"}
OWNERS = (("_21", "south"), ("_2", "west"), ("_1", "north"))


def _pairs(spark, sf):
    li = td.table(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("left_id"), F.col("l_linenumber").alias("right_id")).agg(F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    k, s, o = F.col("k"), F.col("s"), F.col("left_id")
    return per.select(
        "left_id", "right_id", ((k % 50) / 10.0 - 0.5).alias("name_score"), F.when(k % 3 != 0, k % 5).alias("votes"), (1 + k % 5).alias("pages"),
        F.when(F.col("f") == "R", True).when(F.col("f") == "A", False).alias("nisba"), F.when(s % 3 != 0, s % 3 == 1).alias("kunya"),
        (o % 100).alias("death_a"), F.when(s % 4 != 0, F.when(s % 4 == 1, o % 100).when(s % 4 == 2, (o + 99) % 100).otherwise(s % 100)).alias("death_b"),
        (o % 4).alias("rank_a"), F.when(s % 5 != 0, s % 4).alias("rank_b"),
        F.lit("sure").alias("verdict_a"), F.when(k % 4 == 0, "sure").when(k % 4 == 1, "sure enough").when(k % 4 == 2, "surely").alias("verdict_b"),
    )


_PAIRS = """pr AS (SELECT l_orderkey AS o, l_linenumber AS right_id, min(l_partkey) AS k, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
pb AS (SELECT o AS left_id, right_id, (k % 50) / 10::DOUBLE - 0.5::DOUBLE AS ns, CASE WHEN k % 3 <> 0 THEN k % 5 ELSE 0 END AS votes, 1 + k % 5 AS pages,
  CASE f WHEN 'R' THEN 1.5 WHEN 'A' THEN -1 ELSE 0 END + CASE s % 3 WHEN 1 THEN 1.5 WHEN 2 THEN -1 ELSE 0 END AS names, (f = 'R')::INT + (s % 3 = 1)::INT AS n_names,
  CASE s % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE least((s % 100 - o % 100 + 100) % 100, (o % 100 - s % 100 + 100) % 100) END AS gap,
  CASE WHEN s % 5 <> 0 THEN abs(o % 4 - s % 4) END AS ranks, k % 4 AS v FROM pr),
sc AS (SELECT *, round(ns + CASE WHEN votes > 0 THEN 6 * (votes / pages::DOUBLE) + CASE WHEN votes >= 3 THEN 2 ELSE 0 END ELSE 0 END + names
    + CASE WHEN gap IS NULL THEN 0 WHEN gap = 0 THEN 3 WHEN gap <= 2 THEN 1 ELSE -3 END + CASE WHEN ranks = 0 THEN 1.5 WHEN ranks > 1 THEN -1 ELSE 0 END
    + CASE v WHEN 0 THEN 1.5 WHEN 1 THEN 1.5 WHEN 2 THEN -0.7 ELSE 0 END, 6) AS score,
  n_names + coalesce(gap <= 2, false)::INT + coalesce(ranks = 0, false)::INT + (v < 2)::INT AS support,
  ns < 0 OR (coalesce(gap > 2, false) AND NOT (votes > 0 AND votes / pages::DOUBLE >= 0.5 AND ns >= 3.5)) AS hard FROM pb),
rk AS (SELECT *, round(score - coalesce(lead(score) OVER w, -10), 6) AS margin, row_number() OVER w AS n FROM sc WINDOW w AS (PARTITION BY left_id ORDER BY score DESC, right_id))"""


def _gold(spark, sf):
    li, k = td.table(spark, sf, "lineitem"), F.col("l_partkey")
    gold = F.when(F.col("l_suppkey") % 5 != 0, k % 10 + F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0))
    return linking.gold_report(li.select(F.col("l_returnflag").alias("book"), F.col("l_linestatus").alias("method"), F.when(k % 4 != 0, k % 10).alias("ours"), gold.alias("gold")))


def _covers(spark, sf):
    per = td.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name_id"), F.col("l_suppkey").alias("id")).agg(F.min("l_partkey").alias("k"))
    i, k = F.col("id"), F.col("k")
    return linking.link_by_cover(per.select("name_id", "id", ((3 + k % 2) / 5).alias("cover"), F.when(i % 3 != 0, i % 3 == 1).alias("lineage"), (i % 2 == 0).alias("main"), (i % 4 == 3).alias("marked"), F.when(k % 3 != 0, k % 40).alias("fame")))


def _students(spark, sf):
    per = td.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("id")).agg(F.min("l_partkey").alias("k"), F.min("l_linenumber").alias("n"))
    o = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"))
    return linking.link_students(o, per.select("item_id", (F.col("n") % 3).alias("form"), "id", (F.col("id") % 4 == 0).alias("listed"), (F.col("k") % 40).alias("fame")))


def _heads(spark, sf):
    part = F.col("text_id") % 5
    c = td.chains(spark, sf).select((F.col("text_id") - part).alias("text_id"), part.alias("part"), (F.col("step") - 1).alias("pos"), F.when(F.col("student") % 7 != 0, F.col("student")).alias("id"), part.isin(2, 4).alias("complete"))
    return linking.join_heads(c, td.relations(spark, sf))


def _covered(spark, sf):
    part, w = td.table(spark, sf, "part"), F.split("p_name", " ")
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).select("name", "n", F.split("name", " ").alias("words"))
    return linking.book_coverage(names, part.where("p_size > 40").select(F.col("p_brand").alias("book"), F.array(w[0], F.lower("p_type"), w[1]).alias("words")))


def _spans(spark, sf):
    c, p = td.chains(spark, sf), td.people(spark, sf).select("id", F.array(F.lower("region"), F.lit("of"), F.lower("residence"), (F.col("id") % 3).cast("string")).alias("words"))
    names = c.join(p, c.student == p.id).select("text_id", F.col("step").alias("pos"), F.when(F.col("step") % 3 == 0, F.slice("words", 3, 2)).otherwise(F.col("words")).alias("words"))
    spans = c.where("step % 4 <> 1").join(p, c.student == p.id).select("text_id", (F.col("step") * 10).alias("at"), "words")
    return linking.align_spans(names, spans)


QUERIES: dict[str, tuple[Query, str | None]] = {
    "evidence_map": (
        lambda s, d: linking.best_by_evidence(_pairs(s, d)),
        f"""WITH {_PAIRS} SELECT left_id, right_id, score, margin, CASE WHEN NOT hard AND ns >= 2.5 AND score >= 8 AND margin >= 3 AND (votes > 0 OR support >= 3) THEN 'exact'
  WHEN NOT hard AND ns >= 2.5 AND score >= 5 AND margin >= 2 THEN 'probable' ELSE 'none' END AS confidence FROM rk WHERE n = 1""",
    ),
    "gold_report": (
        _gold,
        """WITH r AS (SELECT l_returnflag AS book, l_linestatus AS method, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 10 END AS ours,
  CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey % 10 + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END END AS gold FROM lineitem)
SELECT book, method, count(*) AS names, count(gold) AS with_gold, count(CASE WHEN ours = gold THEN 1 END) AS alike, count(CASE WHEN ours <> gold THEN 1 END) AS otherwise,
  count(CASE WHEN ours IS NULL THEN gold END) AS unlinked, count(CASE WHEN ours = gold THEN 1 END) / nullif(count(CASE WHEN ours IS NOT NULL THEN gold END), 0)::DOUBLE AS precision
FROM r GROUP BY ROLLUP(book, method)""",
    ),
    "cover_links": (
        _covers,
        """WITH c AS (SELECT name_id, id, (3 + k % 2) / 5::DOUBLE AS cover, id % 3 = 1 AS lineage, id % 2 = 0 AS main, id % 4 = 3 AS marked, CASE WHEN k % 3 <> 0 THEN k % 40 ELSE 0 END AS fame
  FROM (SELECT l_orderkey AS name_id, l_suppkey AS id, min(l_partkey) AS k FROM lineitem GROUP BY ALL)),
a AS (SELECT *, max(cover) OVER (PARTITION BY name_id) AS best, count(*) OVER (PARTITION BY name_id) AS pool FROM c),
b AS (SELECT *, count(*) OVER (PARTITION BY name_id) > 1 AND bool_or(lineage) OVER (PARTITION BY name_id) AS g FROM a WHERE cover = best),
d AS (SELECT *, count(*) OVER (PARTITION BY name_id) > 1 AND g AND bool_or(main) OVER (PARTITION BY name_id) AND NOT bool_and(main) OVER (PARTITION BY name_id) AS h FROM b WHERE lineage OR NOT g),
e AS (SELECT *, count_if(marked) OVER (PARTITION BY name_id) AS k, count(*) OVER (PARTITION BY name_id) AS n FROM d WHERE main OR NOT h),
f AS (SELECT *, rank() OVER (PARTITION BY name_id ORDER BY (CASE WHEN marked OR k = 0 THEN fame ELSE -1 END) DESC, id) AS r, CASE WHEN marked OR k = 0 THEN fame ELSE -1 END AS x FROM e),
z AS (SELECT name_id, any_value(best) AS best, any_value(pool) AS pool, any_value(n) AS n, any_value(k) AS k, any_value(g) AS g, any_value(h) AS h, min(id) AS one, min(CASE WHEN marked THEN id END) AS m,
  max(CASE WHEN r = 1 THEN id END) AS top, max(CASE WHEN r = 1 THEN x END) AS x1, max(CASE WHEN r = 2 THEN x END) AS x2 FROM f GROUP BY name_id),
y AS (SELECT *, x1 >= 3 * greatest(1, x2) AS famous FROM z)
SELECT name_id, CASE WHEN n = 1 THEN one WHEN k = 1 THEN m WHEN famous THEN top END AS id, CASE WHEN n > 1 AND k = 1 THEN 'marker' WHEN n > 1 AND famous THEN 'fame' WHEN n > 1 THEN 'ambiguous'
  WHEN h THEN 'main' WHEN g THEN 'nasab' WHEN pool = 1 THEN 'unique' ELSE 'cover' END AS how, best AS cover FROM y""",
    ),
    "student_links": (
        _students,
        """WITH c AS (SELECT l_orderkey AS item_id, l_suppkey AS id, min(l_linenumber) % 3 AS form, min(l_partkey) % 40 AS fame, l_suppkey % 4 = 0 AS listed FROM lineitem GROUP BY ALL),
a AS (SELECT *, count(*) OVER w AS n, count_if(listed) OVER w AS k FROM (SELECT *, min(form) OVER (PARTITION BY item_id) AS f FROM c) WHERE form = f WINDOW w AS (PARTITION BY item_id)),
r AS (SELECT *, row_number() OVER w AS r, lead(fame) OVER w AS nx FROM a WHERE listed OR k = 0 WINDOW w AS (PARTITION BY item_id ORDER BY fame DESC, id)),
t AS (SELECT *, nx IS NULL OR fame >= 3 * greatest(1, nx) AS big FROM r WHERE r = 1)
SELECT o_orderkey AS item_id, CASE WHEN k = 1 OR (k > 1 AND big) OR (k = 0 AND n = 1) OR (k = 0 AND form = 0 AND big) THEN id END AS id, CASE WHEN k IS NULL THEN 'missing' WHEN k = 1 THEN 'listed' WHEN k > 1 AND big THEN 'listed_fame'
  WHEN k > 1 THEN 'ambiguous' WHEN n = 1 THEN 'unique_unlisted' WHEN form = 0 AND big THEN 'fame_unlisted' ELSE 'unlisted' END AS how
FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN t ON o_orderkey = item_id""",
    ),
    "joined_heads": (
        _heads,
        f"""WITH {CHAINS}, {RELATIONS}, q AS (SELECT text_id - text_id % 5 AS text_id, text_id % 5 AS part, step - 1 AS pos, CASE WHEN student % 7 <> 0 THEN student END AS id, text_id % 5 IN (2, 4) AS complete FROM c),
h AS (SELECT text_id, part, max(pos) AS last, arg_max(id, pos) AS head FROM q WHERE NOT complete AND id IS NOT NULL GROUP BY ALL),
f AS (SELECT h.*, q.part AS other, CASE WHEN q.id = h.head THEN q.pos + 1 ELSE q.pos END AS start, row_number() OVER (PARTITION BY h.text_id, h.part ORDER BY q.part, q.pos) AS n FROM h JOIN q ON q.text_id = h.text_id
  WHERE q.part > h.part AND q.complete AND q.pos > 0 AND (q.id = h.head OR EXISTS (SELECT 1 FROM rel WHERE rel.student = h.head AND rel.teacher = q.id))),
j AS (SELECT * FROM f WHERE n = 1)
SELECT text_id, part, pos, id FROM q LEFT JOIN j USING (text_id, part) WHERE last IS NULL OR pos <= last
UNION ALL SELECT j.text_id, j.part, last + 1 + pos - start, id FROM j JOIN q ON q.text_id = j.text_id AND q.part = other AND pos >= start""",
    ),
    "book_coverage": (
        _covered,
        """WITH n AS (SELECT p_name AS name, count(*) AS n FROM part GROUP BY ALL), h AS (SELECT DISTINCT p_brand AS book, p_name AS head, lower(p_type) AS t FROM part WHERE p_size > 40),
m AS (SELECT DISTINCT name, n, book FROM n JOIN h ON split_part(name, ' ', 1) = split_part(head, ' ', 1) AND (split_part(name, ' ', 2) = split_part(head, ' ', 2) OR split_part(name, ' ', 2) = t))
SELECT book, count(*) AS names, sum(n)::BIGINT AS occurrences FROM m GROUP BY book
UNION ALL SELECT NULL, count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT DISTINCT name, n FROM m)""",
    ),
    "compilers": (
        lambda s, d: td.people(s, d).select("id", linking.compiles(F.col("name"), F.col("residence"), STARTS).alias("compiles"), linking.owner_of_book(F.col("residence"), OWNERS).alias("owner")),
        f"""WITH {PEOPLE} SELECT id, (residence = 'NATION_1' AND starts_with(name, 'Supplier#00000000')) OR (residence = 'NATION_7' AND starts_with(name, 'Supplier#0000000')) AS compiles,
  CASE WHEN contains(residence, '_21') THEN 'south' WHEN contains(residence, '_2') THEN 'west' WHEN contains(residence, '_1') THEN 'north' ELSE residence END AS owner FROM p""",
    ),
    "span_alignment": (_spans, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
