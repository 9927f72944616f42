"""Queries on people over the driver's tables: entries merged, candidates, mentions, books in order, kin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import replies
from ..functions.text import LATIN
from ..operators import candidates, gain, kin, linking, mentions, merging, ordered, reports
from ..sources import testdata as td
from . import catalog, more
from .oracles import CHAINS, GROUPS, PEOPLE, TEXTS

Query = Callable[[SparkSession, str], DataFrame]
_NONE = "CAST(array() AS array<string>)"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as entries of six sources: segment, nation and a stretch of keys are the lineage, digits of
    the balance the rest."""
    b = "CAST(abs(round(c_acctbal * 100)) AS BIGINT)"
    c = td.table(spark, sf, "customer").join(F.broadcast(td.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr(
        "c_custkey AS id", f"pmod({b}, 10) = 9 AS fallback",
        f"""CASE pmod({b}, 3) WHEN 0 THEN array(c_mktsegment, concat(n_name, c_custkey DIV 600)) WHEN 1 THEN array(c_mktsegment, n_name, concat('f', c_custkey DIV 90))
        ELSE array(c_mktsegment, n_name, concat('f', c_custkey DIV 90), concat('g', pmod({b} DIV 7, 2))) END AS units""",
        f"CASE WHEN pmod({b} DIV 10, 3) = 0 THEN array(concat('t', pmod({b} DIV 31, 2))) ELSE {_NONE} END AS tail",
        f"CASE pmod({b} DIV 100, 4) WHEN 0 THEN {_NONE} WHEN 1 THEN array(concat('n', pmod({b} DIV 11, 3)), concat('r', c_custkey DIV 40)) ELSE array(concat('n', pmod({b} DIV 11, 3))) END AS nisbas",
        f"CASE WHEN pmod({b} DIV 13, 3) = 0 THEN array(concat('k', pmod({b} DIV 17, 2))) ELSE {_NONE} END AS by_names",
        f"CASE pmod({b} DIV 19, 5) WHEN 0 THEN '100' WHEN 1 THEN '101' END AS death", f"array(CASE pmod({b} DIV 23, 6) WHEN 0 THEN 'primary' ELSE concat('s', pmod({b} DIV 23, 6)) END) AS sources",
        f"CAST(pmod({b} DIV 29, 7) AS INT) AS listed", f"pmod({b} DIV 37, 20) = 0 AS points", "array(n_name) AS fathers",
    )


_ENTRIES = """b AS (SELECT c_custkey AS id, c_mktsegment AS s, n_name AS n, abs(round(c_acctbal * 100))::BIGINT AS b FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT id, b % 10 = 9 AS fallback, CASE b % 3 WHEN 0 THEN [s, n || (id // 600)] WHEN 1 THEN [s, n, 'f' || (id // 90)] ELSE [s, n, 'f' || (id // 90), 'g' || (b // 7 % 2)] END AS units,
  CASE WHEN b // 10 % 3 = 0 THEN ['t' || (b // 31 % 2)] ELSE [] END AS tail,
  CASE b // 100 % 4 WHEN 0 THEN [] WHEN 1 THEN ['n' || (b // 11 % 3), 'r' || (id // 40)] ELSE ['n' || (b // 11 % 3)] END AS nisbas,
  CASE WHEN b // 13 % 3 = 0 THEN ['k' || (b // 17 % 2)] ELSE [] END AS by_names, CASE b // 19 % 5 WHEN 0 THEN '100' WHEN 1 THEN '101' END AS death,
  CASE b // 23 % 6 WHEN 0 THEN 'primary' ELSE 's' || (b // 23 % 6) END AS source FROM b)"""


def _merge_pairs(spark, sf):
    e = merging.prepared(entries(spark, sf))
    return merging.pairs(e, merging.blocks(e)).drop("first")


_PAIRS_SQL = f"""WITH {_ENTRIES}, each AS (SELECT id, unnest(nisbas) AS n FROM e), rare AS (SELECT n FROM each GROUP BY n HAVING count(*) <= 4),
few AS (SELECT id, list(n) AS ns FROM each SEMI JOIN rare USING (n) GROUP BY id),
m AS (SELECT 3 AS kind, fallback, units[1] AS u1, units[2] AS u2, units[3] AS u3, id FROM e WHERE len(units) >= 3
  UNION ALL SELECT 2, fallback, units[1], units[2], unnest(nisbas), id FROM e WHERE len(units) = 2),
k AS (SELECT kind, fallback, u1, u2, u3, bool_or(source = 'primary') AS beside FROM m JOIN e USING (id, fallback) GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT source) = count(*)),
p AS (SELECT k.*, x.id AS a, y.id AS b FROM k JOIN m x USING (kind, fallback, u1, u2, u3) JOIN m y USING (kind, fallback, u1, u2, u3) WHERE x.id < y.id)
SELECT kind, p.fallback, u1, u2, u3, a, b,
  coalesce(x.units[4] <> y.units[4], false) OR (len(x.nisbas) > 0 AND len(y.nisbas) > 0 AND NOT list_has_any(x.nisbas, y.nisbas))
    OR (len(x.by_names) > 0 AND len(y.by_names) > 0 AND NOT list_has_any(x.by_names, y.by_names)) OR coalesce(x.death <> y.death, false) AS clash,
  CASE WHEN kind = 2 THEN x.tail = y.tail OR coalesce(list_has_any(fx.ns, fy.ns), false)
    ELSE list_has_any(x.nisbas, y.nisbas) OR list_has_any(x.by_names, y.by_names) OR (NOT beside AND (x.units = y.units
      OR CASE WHEN len(x.units) > len(y.units) THEN x.units[1:len(y.units)] = y.units AND len(y.tail) = 0 ELSE y.units[1:len(x.units)] = x.units AND len(x.tail) = 0 END)) END AS supports
FROM p JOIN e x ON x.id = a JOIN e y ON y.id = b LEFT JOIN few fx ON fx.id = a LEFT JOIN few fy ON fy.id = b"""


def _people(spark, sf):
    """Parts as people: adjective, noun, type and a stretch of keys are the lineage."""
    return td.table(spark, sf, "part").selectExpr("*", "split(p_name, ' ') AS w", "lower(p_type) AS t", "lower(p_brand) AS b", "concat('g', p_partkey DIV 400) AS g", "p_size AS z").selectExpr(
        "p_partkey AS id", "z % 5 = 0 AS fallback", "w[0] AS first", "array(w[0], w[1], t, g) AS units", "CASE WHEN z % 11 = 0 THEN array(w[0], t, w[1]) END AS other_units", "array(w[0], w[1], t, g) AS own",
        f"concat(array(w[0], w[1], t, g), CASE WHEN z % 2 = 0 THEN array('abu', b) ELSE {_NONE} END) AS words", f"CASE WHEN z % 2 = 0 THEN array(b) ELSE {_NONE} END AS by_names",
        f"CASE WHEN z % 3 = 0 THEN array(concat(g, t)) ELSE {_NONE} END AS titles", "z % 17 = 0 AS by_headed",
        "CASE WHEN z % 7 = 0 THEN array(array(b, w[0], g)) WHEN z % 13 = 0 THEN array(array(noun, g)) ELSE CAST(array() AS array<array<string>>) END AS aliases".replace("noun", "w[1]"),
        "CASE WHEN z % 9 = 0 THEN array(array(w[1], b, g)) ELSE CAST(array() AS array<array<string>>) END AS refs", "z AS fame", "t", "b", "g", "w",
    )


def _names(spark, sf):
    """For each part one form of its name."""
    k = "CASE id % 9"
    return _people(spark, sf).selectExpr(
        "id AS name_id", f"""{k} WHEN 0 THEN array(w[0], w[1], g) WHEN 1 THEN array(w[0], t, g) WHEN 2 THEN array('abu', b, g) WHEN 3 THEN array('abu', b, w[1], g) WHEN 4 THEN array(w[1], t, g)
        WHEN 5 THEN array(b, w[0], g) WHEN 6 THEN array(w[1], b, g) WHEN 7 THEN array(concat(g, t)) ELSE array(w[1], g) END AS words""",
        f"{k} WHEN 0 THEN array(w[0], w[1]) WHEN 1 THEN array(w[0], t) ELSE {_NONE} END AS chain", "id % 9 = 4 AS son", "id % 9 = 3 AS by_son", "id % 9 = 7 AND fame % 2 = 1 AS article",
    )


#: Names with every person, tier by tier, in the order in which they are asked.
_TIERS_SQL = """WITH p AS (SELECT p_partkey AS id, p_size AS z, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2, lower(p_type) AS t, lower(p_brand) AS b, 'g' || (p_partkey // 400) AS g FROM part),
e AS (SELECT *, z % 5 = 0 AS fallback, [w1, w2, t, g] AS own, CASE WHEN z % 11 = 0 THEN [w1, t, w2] END AS other, z % 2 = 0 AS named_so, [w1, w2, t, g] || CASE WHEN z % 2 = 0 THEN ['abu', b] ELSE [] END AS words FROM p),
n AS (SELECT id AS name_id, z AS nz, id % 9 AS k, CASE id % 9 WHEN 0 THEN [w1, w2, g] WHEN 1 THEN [w1, t, g] WHEN 2 THEN ['abu', b, g] WHEN 3 THEN ['abu', b, w2, g] WHEN 4 THEN [w2, t, g] WHEN 5 THEN [b, w1, g]
  WHEN 6 THEN [w2, b, g] WHEN 7 THEN [g || t] ELSE [w2, g] END AS nw, CASE id % 9 WHEN 0 THEN [w1, w2] WHEN 1 THEN [w1, t] ELSE [] END AS chain FROM p),
x AS (SELECT *, len(list_filter(nw, lambda v: NOT list_contains(words, v))) = 0 AS holds, len(chain) < 2 OR own[1:len(chain)] = chain OR coalesce(other[1:len(chain)] = chain, false) AS fits FROM n CROSS JOIN e),
f AS (SELECT name_id, id, fallback, z, k, nw, w1, w2, own, other, words, fits, holds,
  z % 7 = 0 AND nw = [b, w1, g] AS alias, z % 13 = 0 AND z % 7 <> 0 AND nw = [w2, g] AS loose, z % 9 = 0 AND nw = [w2, b, g] AS ref, k = 4 AND own[2:4] = nw AS son,
  holds AND k <> 4 AND fits AND CASE WHEN nw[1] = 'abu' THEN named_so AND nw[2] = b ELSE nw[1] = w1 END AS anchored,
  k IN (2, 3) AND named_so AND nw[2] = b AND CASE WHEN k = 3 THEN nw[3] = w2 OR nw[3] = t OR nw[3] = g ELSE len(list_filter(nw[3:], lambda v: NOT list_contains(words, v))) = 0 AND fits END AS led,
  k NOT IN (2, 3, 4, 7) AND (words[1:2] = nw[1:2] OR coalesce(other[1:2] = nw[1:2], false)) AND fits AS two,
  k NOT IN (2, 3, 4, 7) AND w1 = nw[1] AND z % 17 <> 0 AND nw[3] = g AND (nw[2] = w2 OR nw[2] = t) AS grand,
  k = 7 AND nz % 2 = 1 AND (z % 3 = 0 AND nw[1] = g || t) AS title, k = 7 AND nz % 2 = 0 AND z % 3 = 0 AND nw[1] = g || t AS bare FROM x
  WHERE holds OR (k <> 4 AND (words[1:2] = nw[1:2] OR other[1:2] = nw[1:2])) OR list_contains(nw, g) OR k IN (3, 7)),
a AS (SELECT *, bool_or(holds AND k <> 4) OVER w AS met FROM f WINDOW w AS (PARTITION BY name_id, fallback)),
c AS (SELECT *, CASE WHEN alias THEN 0 WHEN k = 4 AND (son OR ref) THEN 1 WHEN anchored THEN 2 WHEN led AND NOT met THEN 3 WHEN two AND NOT met THEN 4 WHEN grand THEN 5 WHEN ref THEN 6 WHEN title THEN 7 WHEN bare THEN 8 END AS tier FROM a),
h AS (SELECT *, max(CASE WHEN tier = 1 THEN z END) OVER w AS fame, min(tier) OVER w AS least, bool_or(tier = 2 AND k = 3 AND w2 = nw[3]) OVER w AS fathers, bool_or(tier = 2 AND k = 2 AND nw[3] = w1) OVER w AS firsts,
  max(CASE WHEN tier = 4 THEN len(list_intersect(nw, words)) END) OVER w AS shared FROM c WHERE tier IS NOT NULL OR loose WINDOW w AS (PARTITION BY name_id, fallback)),
s AS (SELECT name_id, id, fallback, CASE WHEN tier IS NOT NULL AND tier = least THEN tier ELSE 9 END AS tier FROM h WHERE loose OR (tier = least AND (tier <> 2 OR ((k <> 3 OR NOT fathers OR w2 = nw[3]) AND (k <> 2 OR NOT firsts OR nw[3] = w1)))
  AND (tier <> 4 OR len(list_intersect(nw, words)) = shared))),
r AS (SELECT *, bool_or(NOT fallback) OVER (PARTITION BY name_id) AS main FROM s)
SELECT name_id, id, ['alias', 'son', 'whole', 'by_name', 'two', 'grandfather', 'reference', 'title', 'bare_title', 'loose'][tier + 1] AS tier FROM r WHERE NOT fallback OR NOT main"""

_LATIN = dict(words=lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda x: x != ""), connectors=("of",), son="by", daughter="to", article="th", about="in", and_="a")


def _mentioned(spark, sf):
    """Documents as people named by their first words, seen in ten documents each."""
    d = td.table(spark, sf, "documents")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda x: x != "")
    word = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    gid = F.floor(F.col("doc_id") / 10)
    people = d.select(gid.alias("gid"), F.col("doc_id").alias("person"), F.when(word(1) != "", F.concat_ws(" of ", word(0), word(1))).otherwise(word(0)).alias("name"), word(2).alias("known_as"), F.concat_ws(" ", word(3), word(4)).alias("by_name"))
    seen = people.select("gid", "person").join(d.select(gid.alias("gid"), F.col("doc_id").alias("text_id")), "gid")
    return mentions.mentioned(people, seen, d.select(F.col("doc_id").alias("text_id"), "text"), **_LATIN)


_MENTIONED_SQL = r"""WITH d AS (SELECT doc_id, doc_id // 10 AS gid, list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}]+'), lambda v: v <> '') AS w FROM documents),
p AS (SELECT gid, doc_id AS person, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c, trim(coalesce(w[4], '') || ' ' || coalesce(w[5], '')) AS e FROM d),
l AS (SELECT gid, person, CASE WHEN b <> '' THEN a || ' of ' || b ELSE a END AS name, unnest([1, 2, 3, 4, 5]) AS nth, unnest([CASE WHEN a <> '' THEN a END, CASE WHEN b <> '' THEN a || ' of ' || b END, CASE WHEN b <> '' THEN 'by ' || b END, CASE WHEN length(c) > 1 THEN c END, CASE WHEN length(e) > 1 THEN e END]) AS display FROM p),
f AS (SELECT *, list_filter(string_split_regex(lower(display), '[^\p{L}]+'), lambda v: v <> '') AS tokens FROM l WHERE display IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gid, person, list_filter(string_split_regex(lower(display), '[^\p{L}]+'), lambda v: v <> '') ORDER BY nth) = 1),
t AS (SELECT doc_id, gid, i, x, lower(x) AS v, list_transform(w, lambda y: lower(y)) AS ws FROM (SELECT doc_id, gid, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)),
h AS (SELECT DISTINCT gid, tokens FROM f WHERE len(tokens) > 0),
g AS (SELECT gid, tokens, unnest(string_split_regex('00 01', ' ')) AS plus, tokens[1] AS head FROM h),
o AS (SELECT t.gid, g.tokens, count(*) AS n FROM g JOIN t ON t.gid = g.gid AND t.v = CASE WHEN plus = '00' THEN head ELSE 'a' || head END
  WHERE t.ws[t.i + 1 : t.i + len(g.tokens) - 1] = g.tokens[2:] AND t.i + len(g.tokens) - 1 <= len(t.ws)
    AND NOT (t.i > 1 AND head NOT IN ('of', 'in') AND t.ws[t.i - 1] IN ('of', 'in')) AND NOT (coalesce(t.ws[t.i + len(g.tokens)] = 'of', false) AND NOT list_contains(g.tokens, 'of')) GROUP BY ALL),
k AS (SELECT f.*, coalesce(n, 0) AS n FROM f LEFT JOIN o USING (gid, tokens) WHERE len(tokens) > 0),
u AS (SELECT * FROM k WHERE n > 0 QUALIFY count(*) OVER (PARTITION BY gid, tokens) = 1),
best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY gid, person ORDER BY n DESC, len(tokens) DESC, nth) = 1),
ti AS (SELECT gid, person, display, tokens, name, unnest(list_distinct(string_split(name, ' '))) AS word FROM best),
tt AS (SELECT *, lower(word) AS tok, list_position(string_split(name, ' '), word) AS nth FROM ti WHERE length(word) > 3 AND starts_with(word, 'th')),
mine AS (SELECT DISTINCT gid, person FROM tt WHERE len(tokens) = 1 AND tokens[1] = tok),
q AS (SELECT gid, person, word, nth, tokens || [tok] AS key FROM tt ANTI JOIN mine USING (gid, person) WHERE NOT list_contains(tokens, tok)),
r AS (SELECT q.gid, q.person, q.word, q.nth, count(*) AS n FROM q JOIN t ON t.gid = q.gid AND t.v IN (q.key[1], 'a' || q.key[1])
  WHERE t.ws[t.i + 1 : t.i + len(q.key) - 1] = q.key[2:] AND NOT (t.i > 1 AND q.key[1] NOT IN ('of', 'in') AND t.ws[t.i - 1] IN ('of', 'in')) AND NOT (coalesce(t.ws[t.i + len(q.key)] = 'of', false) AND NOT list_contains(q.key, 'of')) GROUP BY ALL),
z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY gid, person ORDER BY n DESC, nth) = 1)
SELECT gid, person, CASE WHEN display IS NOT NULL THEN display || coalesce(' ' || word, '') END AS mentioned FROM p LEFT JOIN best USING (gid, person) LEFT JOIN z USING (gid, person)"""


def _books(spark, sf):
    """Books of 200 parts; the second one has them in another order within tens, some cut short, some left out."""
    e = td.table(spark, sf, "part").selectExpr("p_partkey DIV 200 AS gid", "p_partkey AS k", "concat(split(p_name, ' '), array(lower(p_type))) AS words", "array(p_brand) AS symbols", "p_size AS z")
    at = lambda *o: (F.row_number().over(Window.partitionBy("gid").orderBy(*o)) - 1).cast("long").alias("pos")
    left = e.select("gid", at("k"), "words", "symbols")
    right = e.where("z % 10 <> 0").select("gid", at(F.floor(F.col("k") / 10), "z", "k"), F.expr("CASE WHEN z % 4 = 0 THEN slice(words, 1, 2) ELSE words END").alias("words"), "symbols")
    return ordered.align_books(left, right)


def _lineages(spark, sf):
    """Each part's father is the next part of its thousand, if lines of orders list him among the teachers."""
    w = Window.partitionBy(F.expr("p_partkey DIV 1000")).orderBy("p_partkey")
    noun = F.element_at(F.split("p_name", " "), 2)
    p = td.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), noun.alias("first"), F.array_compact(F.array(noun, F.lead(noun, 1).over(w), F.lead(noun, 2).over(w), F.lead(noun, 3).over(w))).alias("units"))
    li = td.table(spark, sf, "lineitem")
    listed = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("student"), (F.col("l_partkey") + F.col("l_linenumber")).alias("teacher")).distinct()
    return p.withColumn("other_units", F.lit(None).cast("array<string>")).withColumn("by_names", F.array().cast("array<string>")), listed


def _fathers(spark, sf):
    return kin.fathers(*_lineages(spark, sf))


_FATHERS_SQL = """WITH p AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS first, list_filter([split_part(p_name, ' ', 2), lead(split_part(p_name, ' ', 2), 1) OVER w, lead(split_part(p_name, ' ', 2), 2) OVER w, lead(split_part(p_name, ' ', 2), 3) OVER w], lambda x: x IS NOT NULL) AS units
  FROM part WINDOW w AS (PARTITION BY p_partkey // 1000 ORDER BY p_partkey)),
l AS (SELECT DISTINCT l_partkey AS s, l_partkey + l_linenumber AS t FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT a.id, b.id AS parent, least(len(a.units) - 1, len(b.units)) AS n, a.units AS u, b.units AS v, EXISTS (SELECT 1 FROM l WHERE s = a.id AND t = b.id) AS listed FROM p a JOIN p b ON b.first = a.units[2] AND len(a.units) >= 2),
y AS (SELECT id, parent, listed, n >= 2 AND v[1:n] = u[2:n + 1] AS g FROM x),
z AS (SELECT *, bool_or(g AND listed) OVER (PARTITION BY id) AS any_on, bool_or(listed) OVER (PARTITION BY id) AS met, count_if(g AND id <> parent) OVER (PARTITION BY id) AS k FROM y)
SELECT id, parent, listed FROM z WHERE (listed AND (g OR NOT any_on)) OR (NOT met AND g AND id <> parent AND k = 1)"""


def _kin_chains(spark, sf):
    """Chains of parts of orders, some named only as the one before's father or grandfather."""
    people, listed = _lineages(spark, sf)
    parents = kin.fathers(people, listed)
    li = td.table(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_orderkey").alias("text_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("k"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    how = F.when(F.col("f") == "A", F.when(F.col("q") % 3 == 0, kin.GRANDFATHER).when(F.col("q") % 3 == 1, kin.FATHER))
    near = F.array_distinct(F.array("k", F.col("k") + 1, F.col("k") + F.col("pos")))
    names = per.select("text_id", "pos", F.when(how.isNull(), near).otherwise(F.array().cast("array<bigint>")).alias("candidates"), how.alias("kin"))
    filled = kin.with_kin(names, parents)
    facts = per.select("text_id", "pos", (F.col("q") % 2 == 0).alias("led"), (F.col("q") % 5 == 0).alias("whole"), F.when(F.col("q") % 7 == 0, F.col("k")).alias("usual"), F.when(F.col("q") % 2 == 1, F.array(F.col("f"))).alias("want"))
    flags = li.groupBy(F.col("l_partkey").alias("student"), (F.col("l_partkey") + F.col("l_linenumber")).alias("teacher")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    listing = flags.select("student", "teacher", F.when(F.array_contains("f", "R"), F.transform("f", lambda x: F.array(x))).alias("in_student"), F.when(F.array_contains("f", "N"), F.array(F.col("f"))).alias("in_teacher"))
    fame = td.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("fame"))
    return kin.resolve(filled.join(facts, ["text_id", "pos"]), listing, fame)


def _replies(spark, sf):
    """A model's reply to every ten documents, names in capitals: levels by the text's length, quotes of four
    words or two, from the text itself or from the next one's."""
    t = td.texts(spark, sf).select((F.floor(F.col("id") / 10)).alias("request_id"), (F.col("id") % 10 + 1).cast("int").alias("place"), "id", F.coalesce("matn", F.lit("")).alias("matn"), "chapter")
    n = F.length("matn")
    quote = F.array_join(F.slice(F.split(F.trim(replies.folded_words(F.when(n % 7 == 0, F.lead("matn").over(Window.partitionBy("request_id").orderBy("place"))).otherwise(F.col("matn")), LATIN)), " "), 1, F.when(n % 5 == 0, 2).otherwise(4)), " ")
    level = F.when(n % 3 == 0, "DIRECT").when(n % 11 == 0, "sure").otherwise(" Partial")
    each = F.to_json(F.struct(F.when(n % 13 == 0, 1).otherwise(F.col("place")).alias("Index"), level.alias("LEVEL"), quote.alias("Quote"), F.col("chapter").alias("reason")))
    said = t.select("request_id", "place", each.alias("x")).groupBy("request_id").agg(F.concat(F.lit("Here: ["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda v: v["x"]), ", "), F.lit("] Done.")).alias("raw"))
    return replies.judged(said, t.select("request_id", "place", "id", "matn"), lex=LATIN)


_REPLIES_SQL = f"""WITH {TEXTS}, a AS (SELECT id // 10 AS request_id, id % 10 + 1 AS place, id, length(coalesce(matn, '')) AS n, regexp_extract_all(coalesce(norm, ''), '[a-z]+') AS w, chapter FROM t),
b AS (SELECT *, CASE WHEN n % 7 = 0 THEN coalesce(lead(w) OVER (PARTITION BY request_id ORDER BY place), []) ELSE w END AS q FROM a),
s AS (SELECT request_id, CASE WHEN n % 13 = 0 THEN 1 ELSE place END AS place, q[1:CASE WHEN n % 5 = 0 THEN 2 ELSE 4 END] AS q, CASE WHEN n % 3 = 0 THEN 'direct' WHEN n % 11 = 0 THEN 'sure' ELSE 'partial' END AS level, chapter FROM b),
o AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY request_id, place) = 1),
r AS (SELECT b.request_id, b.place, b.id, o.level, o.q, o.chapter, coalesce(o.level <> 'sure' AND len(o.q) >= 3 AND contains(' ' || array_to_string(b.w, ' ') || ' ', ' ' || array_to_string(o.q, ' ') || ' '), false) AS ok FROM b LEFT JOIN o USING (request_id, place))
SELECT request_id, place::INT AS place, id, CASE WHEN ok THEN level END AS level, CASE WHEN ok THEN array_to_string(q, ' ') END AS quote, CASE WHEN ok THEN coalesce(chapter, '') END AS reason FROM r"""


def _gain(spark, sf):
    """Brands as books that hold names of parts, each as often as there are such parts."""
    p = td.table(spark, sf, "part").select(F.col("p_brand").alias("book"), F.concat_ws(" ", "p_name", "p_type", F.floor(F.col("p_size") / 5).cast("string")).alias("name"))
    return gain.order_of_gain(p.distinct().join(p.groupBy("name").agg(F.count("*").alias("n")), "name"), "Brand#1")


def _votes(spark, sf):
    """Lines of orders cite pages; parts are the entries of three books."""
    part = td.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(*map(F.lit, "ANR")), (F.col("p_size") % 3 + 1).cast("int")).alias("own"))
    vol = (F.col("k") % 7 + 1).cast("int")
    index = part.select(F.explode(F.array(*map(F.lit, "ANR"))).alias("book"), vol.alias("vol"), F.col("k").alias("printed"), (F.floor(F.col("k") / 3) + vol).alias("page"))
    entries_ = part.select(F.col("own").alias("book"), F.col("k").alias("entry"), F.floor(F.col("k") / 3).alias("page"))
    li = td.table(spark, sf, "lineitem")
    cites = li.select(F.col("l_orderkey").alias("left_id"), F.col("l_returnflag").alias("book"), F.col("l_linenumber").cast("int").alias("vol"), F.col("l_partkey").alias("printed"))
    return linking.page_votes(cites, index, entries_)


_VOTES_SQL = """WITH p AS (SELECT p_partkey AS k, ['A', 'N', 'R'][p_size % 3 + 1] AS book, p_partkey // 3 AS page FROM part),
c AS (SELECT l_orderkey AS left_id, l_returnflag AS book, l_partkey // 3 + l_linenumber AS page FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = l_partkey % 7 + 1),
g AS (SELECT DISTINCT book, page FROM c), b AS (SELECT g.book, g.page, max(p.page * 100000000 + k) % 100000000 AS k FROM g JOIN p ON p.book = g.book AND p.page < g.page GROUP BY ALL),
o AS (SELECT g.book, g.page, k FROM g JOIN p USING (book, page) UNION SELECT book, page, k FROM b), t AS (SELECT left_id, count(*) AS pages FROM c GROUP BY left_id)
SELECT left_id, k AS right_id, count(*) AS votes, any_value(pages) AS pages FROM c JOIN o USING (book, page) JOIN t USING (left_id) GROUP BY left_id, k"""


#: Words that a text's wording may differ in without saying anything else.
_FRAME = frozenset("the of and to in".split())


def _asked(spark, sf):
    """Thirty orders at a time, in the order of their date, as the texts that a caller compares."""
    o = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("text_id"), F.unix_timestamp("o_orderdate").alias("ord"))
    return catalog._groups(spark, sf).join(o, "text_id").select("gid", "text_id", "book", "ord")


def _heard(spark, sf):
    return td.chains(spark, sf).select("sheikh", "student").distinct().withColumn("timing", ((F.col("sheikh") + F.col("student")) % 5).cast("int"))


def _report(spark, sf) -> reports.Report:
    return reports.report(td.chains(spark, sf), td.texts(spark, sf).select("id", "matn"), _asked(spark, sf), td.people(spark, sf), td.relations(spark, sf), _heard(spark, sf), catalog.TRUSTED, LATIN, _FRAME)


_ROUTES_SQL = f"""WITH {PEOPLE}, {CHAINS}, {GROUPS},
r AS (SELECT text_id, arg_max(sheikh, {{'r': rank, 's': -step}}) FILTER (rank IS NOT NULL) AS weakest, max(rank)::INT AS tier, count_if(rank IS NULL)::BIGINT AS unrated FROM c JOIN p ON p.id = sheikh GROUP BY text_id),
t AS (SELECT gid, text_id, book, arg_max(sheikh, step) AS top FROM c JOIN g USING (text_id) GROUP BY ALL),
k AS (SELECT gid, top, count(*) AS n, min(text_id) AS first FROM t JOIN p ON p.id = top WHERE rank = 1 GROUP BY ALL),
m AS (SELECT gid, top AS main FROM k QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n DESC, first) = 1)
SELECT t.gid, t.text_id, coalesce(regexp_matches(COMPARABLE, 'the\\s+that|thing\\w*') OR regexp_matches(regexp_replace(coalesce(text, ''), '\\p{{Mn}}', '', 'g'), 'theat'), false) AS raised,
  weakest, tier, unrated, t.top, coalesce(p.rank = 1 AND t.top <> main, false) AS is_witness
FROM t LEFT JOIN r USING (text_id) LEFT JOIN m USING (gid) LEFT JOIN p ON p.id = t.top LEFT JOIN documents ON doc_id = t.text_id"""


def _tree(spark, sf) -> reports.Tree:
    """The people that chains name have their documents' first words for names."""
    d = td.table(spark, sf, "documents")
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda x: x != "")
    names = d.select(F.col("doc_id").alias("id"), F.get(w, F.lit(0)).alias("name"), F.get(w, F.lit(1)).alias("known_as"), F.lit(None).cast("string").alias("by_name"))
    people = td.people(spark, sf).drop("name").join(names, "id", "left")
    return reports.comparative_tree(
        td.chains(spark, sf), td.texts(spark, sf).select("id", "matn"), _asked(spark, sf), people, td.relations(spark, sf), _heard(spark, sf), catalog.TRUSTED, LATIN, _FRAME, **_LATIN
    )


QUERIES: dict[str, tuple[Query, str | None]] = {
    "report_findings": (lambda s, d: _report(s, d).findings.drop("place"), None),
    "report_routes": (lambda s, d: _report(s, d).routes, _ROUTES_SQL.replace("COMPARABLE", more._comparable("text"))),
    "tree_nodes": (lambda s, d: _tree(s, d).nodes, None),
    "tree_grades": (lambda s, d: _tree(s, d).grades, None),
    "order_of_gain": (_gain, None),
    "page_votes": (_votes, _VOTES_SQL),
    "judged_replies": (_replies, _REPLIES_SQL),
    "merged_person_pairs": (_merge_pairs, _PAIRS_SQL),
    "merged_persons": (lambda s, d: merging.same_person(entries(s, d)), None),
    "candidate_tiers": (lambda s, d: candidates.candidates(_names(s, d), _people(s, d), "abu"), _TIERS_SQL),
    "mentioned_names": (_mentioned, _MENTIONED_SQL),
    "aligned_books": (_books, None),
    "father_links": (_fathers, _FATHERS_SQL),
    "kin_chains": (_kin_chains, None),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
