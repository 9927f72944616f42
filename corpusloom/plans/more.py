"""Further queries over the driver's tables, each with its SQL beside it: text functions, loading transforms,
reports over findings and graphs, resolution of names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.places import nothing_in_common, places_of
from ..functions.replies import tier_status
from ..functions.scoring import raw_index_column
from ..functions.text import LATIN, comparable, extract, highlight, is_raised, phrase_grounded, quote_grounded, score_tokens, snippet, words
from ..operators import catalogue, compare, etl, graph, resolve, rules, search
from ..sources import testdata as td
from . import catalog
from .oracles import CHAINS, GROUPS, LINKS, MASKING, ORACLES, PEOPLE, RELATIONS, TEXTS

Query = Callable[[SparkSession, str], DataFrame]
TERMS = ["anti", "there"]
REGIONS = {"nation_0": "south", "nation_5": "south", "nation_10": "south", "nation_1": "west", "nation_6": "west", "nation_11": "west"}
TYPES = ("raised_stopped", "masking")


def _comparable(x: str) -> str:
    plain = f"translate(translate(lower(regexp_replace(coalesce({x}, ''), '\\p{{Mn}}', '', 'g')), 'éèêàâçôûüäößñóíáú''', 'eeeaacouuaosnoiau'), '-', ' ')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({plain}, '\\bhon\\b', ' ', 'g'), '[^\\p{{L}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    """Words for scoring, not stemmed."""
    return f"list_filter(regexp_split_to_array(translate(regexp_replace(translate(lower(coalesce({x}, '')), 'éèêàâçôûüäößñóíáú''', 'eeeaacouuaosnoiau'), '[^a-z\\s]', ' ', 'g'), 'y', 'i'), '\\s+'), lambda w: w <> '')"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate({x}, '''', ''), '[«»\"“”'']', '', 'g'), '\\s+', ' ', 'g'))"


#: Texts of one book next to each other.
NEXT = f"{TEXTS}, nx AS (SELECT id, matn, lead(id) OVER w AS other, lead(matn) OVER w AS b FROM t WINDOW w AS (PARTITION BY book ORDER BY id))"


def _next(spark, sf):
    w = Window.partitionBy("book").orderBy("id")
    return td.texts(spark, sf).select("id", "matn", F.lead("id").over(w).alias("other"), F.lead("matn").over(w).alias("b")).where("other IS NOT NULL")


def _grounded(spark, sf):
    n = _next(spark, sf)
    quote, phrase = F.left("b", F.lit(5)), F.left("b", F.lit(16))
    tier = F.concat(F.lit("T"), (F.col("id") % 15).cast("string"))
    return n.select("id", "other", quote_grounded(quote, F.array("matn"), LATIN).alias("quoted"), phrase_grounded(phrase, F.col("matn"), F.col("b"), LATIN).alias("together"), tier_status(tier, quote, F.array("matn"), LATIN).alias("status"))


def _hearings_of(spark, sf):
    """What each line of an order says of a pair: one hearing, with the claims of up to three lines."""
    li = td.table(spark, sf, "lineitem")
    claim = F.struct(etl.timing_code(F.element_at(F.array(*map(F.lit, etl.TIMINGS)), (F.col("l_linenumber") % 5 + 1).cast("int"))).alias("timing"), F.concat(F.lit("q"), F.col("l_partkey").cast("string")).alias("quote"), F.col("l_returnflag").alias("book"))
    own = li.groupBy(F.col("l_orderkey").alias("text_id")).agg(F.slice(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", claim.alias("c")))), 1, 3).alias("x")).select("text_id", F.transform("x", lambda v: v["c"]).alias("claims"))
    return td.chains(spark, sf).join(own, "text_id").select("sheikh", "student", (F.col("text_id") * 100 + F.col("step")).alias("pos"), (F.col("step") % 5).cast("int").alias("timing"), "claims")


def _mixed(spark, sf):
    d, i = td.table(spark, sf, "documents"), F.col("doc_id")
    c = d.select((i % 120 + 1).alias("id"), F.when(i % 3 != 0, 1 + i % 3).cast("int").alias("severity"), (i % 5 == 0).alias("none_after"), F.when(i % 2 == 0, F.col("source")).alias("text"), i.alias("pos"))
    return etl.mixed_up_claims(td.people(spark, sf), c).select("id", "mixed_up", "severity", "none_after", "note")


def _chapters(spark, sf):
    o = td.table(spark, sf, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    records = o.select(k.alias("id"), F.concat(F.lit("x/"), s, F.lit(".json")).alias("file"), F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.col("o_orderpriority")).alias("chapter"))
    index = o.select(F.concat(F.lit("y/"), s, F.lit(".json")).alias("file"), F.when(s != "P", F.concat(s, F.lit(" title"))).otherwise(" ").alias("title")).distinct()
    return etl.with_chapters(records, index).select("id", "chapter")


def _named(spark, sf):
    n = td.table(spark, sf, "nation").join(td.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return etl.book_names(n.select(F.col("n_name").alias("slug"), F.lower("n_name").alias("title")), n.where("n_regionkey = 2").select(F.col("n_name").alias("slug"), F.col("r_name").alias("name"))).select("slug", "book")


def _sides(spark, sf):
    s, i = td.table(spark, sf, "supplier"), F.col("s_suppkey")
    one = s.select(i.alias("id"), (i * 3 % 50).cast("string").alias("side_id"), F.when(i % 4 == 0, "exact").otherwise("likely").alias("confidence"))
    two = s.select(i.alias("id"), (i * 7 % 50).cast("string"), F.when(i % 8 == 0, "exact").otherwise("likely"))
    side = td.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("side_id"), F.col("p_name").alias("name"))
    return etl.exact_side_entries(side, one.union(two)).select("id", "side_id", "name")


def _same(spark, sf):
    c, n = td.table(spark, sf, "customer"), td.table(spark, sf, "nation")
    k = F.col("c_custkey")
    theirs = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(k.alias("other"), F.col("n_name").alias("name"), F.when(k % 5 != 0, 70 + k * 13 % 200).cast("int").alias("death"))
    return etl.same_person(td.people(spark, sf).select("id", F.col("residence").alias("name"), "death"), theirs).select("other", "id")


def _quotes(spark, sf):
    d, n, i = td.table(spark, sf, "documents"), td.table(spark, sf, "nation"), F.col("doc_id")
    q = d.select((i % 150).alias("narrator"), (i % 30).alias("scholar_id"), F.left("text", F.lit(40)).alias("text"))
    return etl.scholar_evaluations(q, n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), td.people(spark, sf))


def _export(spark, sf):
    e = etl.chain_export(td.texts(spark, sf), td.chains(spark, sf), td.people(spark, sf), ("src1", "src2"))
    return e.select("id", "book", "number", "head", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["step"].cast("string"), F.coalesce(x["term"], F.lit("-")), x["student"], x["sheikh"])), "|").alias("links"))


def _hearings(spark, sf):
    return catalog._chains(spark, sf).select("sheikh", "student").distinct().withColumn("timing", ((F.col("sheikh") + F.col("student")) % 5).cast("int"))


def _report(spark, sf):
    w = graph.witnesses(td.chains(spark, sf), catalog._groups(spark, sf), td.people(spark, sf))
    return rules.report(catalog._chains(spark, sf), td.people(spark, sf), td.relations(spark, sf), _hearings(spark, sf), w, catalog.TRUSTED, LATIN)


def _two_rules(spark, sf):
    return catalog._masking(spark, sf).unionByName(rules.raised_stopped(catalog._chains(spark, sf), td.people(spark, sf)))


def _on_edges(spark, sf):
    f = catalog._masking(spark, sf).unionByName(rules.hidden_break(catalog._chains(spark, sf), td.people(spark, sf), td.relations(spark, sf), LATIN))
    ends = F.split("people", ",")
    return compare.edge_decorations(f.select("gid", ends[0].alias("student"), ends[1].alias("sheikh"), "type", "severity", "confidence"), all_of_them=True)


def _cases(spark, sf):
    li = td.table(spark, sf, "lineitem")
    kind = lambda c: F.when(c % 3 == 0, "not-found").when(c % 3 == 1, "exact").otherwise("variant")
    return compare.verification_metrics(li.select(F.col("l_returnflag").alias("grp"), kind(F.col("l_linenumber")).alias("expected"), kind(F.col("l_suppkey")).alias("got"), F.col("l_quantity").alias("ms")))


def _flags(spark, sf):
    e = td.links(spark, sf).join(td.books_of_texts(spark, sf), "text_id")
    return graph.edge_flags(e.select("sheikh", "student", (F.col("term") == "heard").alias("flag"), F.array("book").alias("books")))


def _defects(spark, sf):
    g = catalog._groups(spark, sf)
    s = g.select("gid", "text_id", ((F.col("gid") % 3 == 0) | (F.col("text_id") % 2 == 0) & (F.col("gid") % 3 == 1)).alias("harmful"))
    return rules.with_defects(rules.structural_grade(catalog._weakest(spark, sf), g), s)


def _companions(spark, sf):
    c = td.chains(spark, sf).join(catalog._groups(spark, sf), "text_id")
    return graph.by_companion(c.groupBy("gid", F.col("sheikh").alias("person"), "step").agg(F.collect_set("text_id").alias("texts")))


def _varying(spark, sf):
    g = catalog._groups(spark, sf)
    edges = td.chains(spark, sf).join(g, "text_id").groupBy("gid", "step", "student", "sheikh").agg(F.collect_set("text_id").alias("texts"))
    return graph.mark_variants(edges, g.where("text_id % 5 = 0").select("gid", "text_id")).drop("texts")


def _registry(spark, sf):
    r, p = td.relations(spark, sf), td.people(spark, sf)
    t = r.groupBy(F.col("student").alias("id")).agg(F.collect_set("teacher").alias("teachers"))
    s = r.groupBy(F.col("teacher").alias("id")).agg(F.collect_set("student").alias("students"))
    e = p.select("id", F.col("region").alias("source"), F.when(F.col("id") % 2 == 0, F.array("name", "residence")).alias("quotes"))
    return catalogue.registry_statistics(e.join(t, "id", "left").join(s, "id", "left"))


def _summary(spark, sf):
    w = graph.witnesses(td.chains(spark, sf), catalog._groups(spark, sf), td.people(spark, sf)).join(td.books_of_texts(spark, sf), "text_id")
    return catalogue.gathering_summary(w, catalog._masking(spark, sf))


def _apart(spark, sf):
    p = td.people(spark, sf)
    at = F.when(F.col("id") % 5 == 0, F.concat("residence", F.lit(" / Nation_5"))).otherwise(F.col("residence"))
    own = lambda k: p.select(F.col("id").alias(k), places_of(at, lex=LATIN).alias(f"{k}_at"))
    e = td.links(spark, sf).select("student", "sheikh").distinct().join(own("student"), "student").join(own("sheikh"), "sheikh")
    return e.select("student", "sheikh", F.array_join("student_at", "|").alias("places"), nothing_in_common(F.col("student_at"), F.col("sheikh_at"), REGIONS).alias("apart"))


def _ids(spark, sf):
    o = td.table(spark, sf, "orders")
    ids = F.concat_ws(",", F.col("o_custkey").cast("string"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), F.lit("x"), F.col("o_custkey").cast("string"), F.lit(""))
    r = search.request_ids(o.select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 9 != 0, ids).alias("ids")))
    return r.select("request_id", F.array_join(r.ids.cast("array<string>"), ",").alias("ids"), "valid")


def _reciprocity(spark, sf):
    """Items of lists: the number of a person modulo 40, which names all people with that remainder."""
    c, p = td.chains(spark, sf), td.people(spark, sf)
    own = c.select(F.col("student").alias("owner"), F.lit("teachers").alias("side"), (F.col("sheikh") % 40).alias("item")).where("owner % 3 <> 0")
    own = own.union(c.select("sheikh", F.lit("students"), F.col("student") % 40).where("sheikh % 4 <> 0")).distinct()
    return resolve.reciprocity(own, named=p.select((F.col("id") % 40).alias("item"), "id"))


def _opened(spark, sf):
    n = catalog._names(spark, sf)
    n = n.select("text_id", "pos", F.concat(F.lit("n"), (F.coalesce("id", F.lit(0)) % 9).cast("string")).alias("name"), F.when(F.col("id").isNotNull(), F.array("id", F.col("id") % 50 + 1)).otherwise(F.array().cast("array<bigint>")).alias("candidates"))
    first = n.where("pos < 2 AND pos = text_id % 3").select("text_id", F.coalesce(F.get("candidates", F.lit(0)), F.lit(0)).alias("compiler"))
    fame = td.relations(spark, sf).groupBy(F.col("teacher").alias("id")).agg(F.count("*").alias("fame"))
    usual = td.people(spark, sf).select(F.col("id").alias("compiler"), F.lit("n3").alias("name"))
    return resolve.without_opener(n, first, fame, usual).select("text_id", "pos", "name")


def _by_words(spark, sf):
    part, s = td.table(spark, sf, "part"), td.table(spark, sf, "supplier")
    ww, kind = F.split("p_name", " "), F.lower("p_type")
    people = part.select(F.col("p_partkey").alias("id"), ww.alias("words"), F.array(kind).alias("aliases"))
    names = s.join(part, s.s_suppkey == part.p_partkey).select(F.col("s_suppkey").alias("name_id"), F.when(F.col("s_suppkey") % 2 == 0, ww).otherwise(F.array(ww[1], kind)).alias("words"))
    return resolve.candidates_by_words(names, people)


def _cards(spark, sf):
    o = td.table(spark, sf, "orders").select(F.col("o_orderkey").alias("text_id"), F.col("o_custkey").alias("number"))
    c = graph.reference_cards(catalog._groups(spark, sf).join(o, "text_id"))
    return c.select("gid", "book", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), "texts")


def _on_routes(sql: str) -> str:
    """The SQL of a rule, over the texts that aren't witnesses."""
    own = "FROM c JOIN g USING (text_id))"
    assert own in sql
    return sql.replace(own, own[:-1] + f" WHERE text_id NOT IN (SELECT text_id FROM ({ORACLES['witness_flags']}) WHERE is_witness))", 1)


RULE_ORDER = ("rule_tadlis", "rule_ikhtilat", "rule_hidden_break", "rule_raf_waqf", "rule_wasl_irsal")
HEARD = "WITH " + CHAINS + ", " + RELATIONS

#: The first place of the longest term with all terms within 800 characters, else its first place; in the raw text by proportion.
WINDOWS = """o AS (SELECT id, norm, string_split(norm, 'there') AS parts FROM t),
  i AS (SELECT id, norm, unnest(list_transform(range(1, len(parts)), lambda j: length(array_to_string(parts[1:j], 'there')))) AS place FROM o WHERE len(parts) > 1),
  f AS (SELECT id, min(place) AS first, min(CASE WHEN contains(substr(norm, greatest(place - 800, 0) + 1, place + 805 - greatest(place - 800, 0)), 'anti') THEN place END) AS near FROM i GROUP BY id),
  w AS (SELECT t.id, matn, norm, CASE WHEN coalesce(near, first, 0) > 0 THEN greatest(0, least(length(matn) - 1, trunc(coalesce(near, first) / length(norm)::DOUBLE * length(matn))))::INT ELSE 0 END AS place FROM t LEFT JOIN f USING (id))"""
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _place():
    return raw_index_column(F.col("matn"), F.col("norm"), TERMS)


QUERIES: dict[str, tuple[Query, str]] = {
    "comparable_words": (
        lambda s, d: td.texts(s, d).select("id", comparable(F.col("matn"), LATIN).alias("c")).select("id", F.size(words(F.col("c"))).alias("n_words"), F.md5("c").alias("digest")),
        f"SELECT id, len(list_filter(string_split(c, ' '), lambda w: w <> ''))::INT AS n_words, md5(c) AS digest FROM (SELECT doc_id AS id, {_comparable('text')} AS c FROM documents)",
    ),
    "raised_texts": (
        lambda s, d: td.texts(s, d).select("id", is_raised(F.col("matn"), LATIN).alias("raised")),
        f"SELECT doc_id AS id, regexp_matches({_comparable('text')}, 'the\\s+that|thing\\w*') OR regexp_matches(regexp_replace(coalesce(text, ''), '\\p{{Mn}}', '', 'g'), 'theat') AS raised FROM documents",
    ),
    "score_words": (
        lambda s, d: td.texts(s, d).select("id", score_tokens(F.col("matn"), LATIN).alias("w")).select("id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("digest")),
        f"SELECT id, len(w)::INT AS n, md5(coalesce(array_to_string(w, ' '), '')) AS digest FROM (SELECT doc_id AS id, {_tokens('text')} AS w FROM documents)",
    ),
    "snippets": (
        lambda s, d: td.texts(s, d).select("id", snippet(F.col("matn"), F.col("norm"), _place()).alias("snippet")),
        f"""WITH {TEXTS}, {WINDOWS}, a AS (SELECT id, matn, norm, greatest(place - 60, 0) AS start FROM w)
  SELECT id, CASE WHEN length(matn) <= 180 THEN matn WHEN norm = '' THEN substr(matn, 1, 150) || '...' ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || {_TRIM.format('substr(matn, start + 1, 180)')} || CASE WHEN start + 180 < length(matn) THEN '...' ELSE '' END END AS snippet FROM a""",
    ),
    "extracts": (
        lambda s, d: td.texts(s, d).select("id", extract(F.col("matn"), F.col("norm"), _place()).alias("x")).select("id", F.length("x").alias("n"), F.md5("x").alias("digest")),
        f"""WITH {TEXTS}, {WINDOWS}, a AS (SELECT id, matn, norm, greatest(place - 600, 0) AS start FROM w),
  x AS (SELECT id, CASE WHEN length(matn) <= 4000 OR norm = '' THEN matn ELSE CASE WHEN start > 0 THEN '... ' ELSE '' END || {_TRIM.format('substr(matn, start + 1, 4000)')} || CASE WHEN start + 4000 < length(matn) THEN ' ...' ELSE '' END END AS x FROM a)
  SELECT id, length(x)::INT AS n, md5(x) AS digest FROM x""",
    ),
    "highlights": (
        lambda s, d: td.texts(s, d).select("id", highlight(F.col("matn"), TERMS, LATIN).alias("x")).select("id", F.length("x").alias("n"), F.md5("x").alias("digest")),
        """WITH x AS (SELECT doc_id AS id, regexp_replace(text, '(?i)(t''*h''*e''*r''*e|a''*n''*t''*i)', '<em>\\1</em>', 'g') AS x FROM documents) SELECT id, length(x)::INT AS n, md5(x) AS digest FROM x""",
    ),
    "grounded": (
        _grounded,
        f"""WITH {NEXT}, q AS (SELECT id, other, matn, b, left(b, 5) AS quote, ' ' || coalesce(array_to_string({_tokens('left(b, 16)')}, ' '), '') || ' ' AS needle, len({_tokens('left(b, 16)')}) AS k FROM nx WHERE other IS NOT NULL),
  r AS (SELECT *, {_plain('quote')} <> '' AND contains({_plain('matn')}, {_plain('quote')}) AS quoted FROM q)
  SELECT id, other, quoted, k >= 3 AND contains(' ' || coalesce(array_to_string({_tokens('matn')}, ' '), '') || ' ', needle) AND contains(' ' || coalesce(array_to_string({_tokens('b')}, ' '), '') || ' ', needle) AS together,
  CASE WHEN coalesce(id % 15 BETWEEN 1 AND 12 AND quoted, false) THEN 'ok' ELSE 'unverified' END AS status FROM r""",
    ),
    "lowest_tier": (
        lambda s, d: etl.lowest_tier(td.people(s, d), td.chains(s, d).where("term = 'from'").select(F.col("sheikh").alias("id"), (1 + F.col("text_id") % 5).cast("int").alias("tier"))).select("id", "tadlis_tier"),
        f"WITH {PEOPLE}, {CHAINS}, n AS (SELECT sheikh AS id, min(1 + text_id % 5) AS k FROM c WHERE term = 'from' GROUP BY sheikh) SELECT id, least(tadlis_tier, k)::INT AS tadlis_tier FROM p LEFT JOIN n USING (id)",
    ),
    "first_hearings": (
        lambda s, d: etl.first_hearings(_hearings_of(s, d), s.createDataFrame([("A", "first book"), ("R", "second book")], "book string, name string")),
        f"""WITH {CHAINS}, l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_linenumber % 5, l_returnflag) AS n FROM lineitem),
  h AS (SELECT sheikh, student, text_id, step % 5 AS timing FROM c QUALIFY row_number() OVER (PARTITION BY sheikh, student ORDER BY text_id, step) = 1),
  k AS (SELECT h.*, l_partkey, l_returnflag FROM h JOIN l ON l_orderkey = text_id AND n <= 3 QUALIFY row_number() OVER (PARTITION BY sheikh, student ORDER BY l_linenumber % 5 <> timing, n) = 1)
  SELECT sheikh, student, timing::INT AS timing, 'q' || l_partkey AS evidence, CASE l_returnflag WHEN 'A' THEN 'first book' WHEN 'R' THEN 'second book' ELSE l_returnflag END AS book FROM k""",
    ),
    "generation_labels": (
        lambda s, d: td.people(s, d).select("id", etl.generation_label(F.col("generation")).alias("label")),
        f"WITH {PEOPLE} SELECT id, ['الأولى', 'الثانية', 'الثالثة', 'الرابعة', 'الخامسة', 'السادسة', 'السابعة', 'الثامنة'][generation] AS label FROM p",
    ),
    "same_person": (
        _same,
        f"""WITH {PEOPLE}, o AS (SELECT c_custkey AS other, n_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN 70 + c_custkey * 13 % 200 END AS d FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT other, id FROM o JOIN p ON p.residence = o.name QUALIFY row_number() OVER (PARTITION BY other ORDER BY NOT coalesce(abs(d - death) <= 5, true), id) = 1""",
    ),
    "chapters_renamed": (
        lambda s, d: etl.rename_chapters(td.texts(s, d), td.texts(s, d).where("chapter = 'en'").select("book", "chapter", F.concat(F.lit("English of "), F.col("book")).alias("new")).distinct()).select("id", "chapter"),
        "SELECT doc_id AS id, CASE WHEN lang = 'en' AND source IS NOT NULL THEN 'English of ' || source ELSE lang END AS chapter FROM documents",
    ),
    "chapters_from_index": (
        _chapters,
        "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority WHEN o_orderstatus <> 'P' THEN o_orderstatus || ' title' END AS chapter FROM orders",
    ),
    "book_names": (_named, "SELECT n_name AS slug, CASE WHEN n_regionkey = 2 THEN r_name ELSE lower(n_name) END AS book FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "side_entries": (
        _sides,
        """WITH m AS (SELECT s_suppkey AS id, s_suppkey * 3 % 50 AS k FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, s_suppkey * 7 % 50 FROM supplier WHERE s_suppkey % 8 = 0)
  SELECT id, k AS side_id, p_name AS name FROM (SELECT id, min(k) AS k FROM m GROUP BY id) JOIN part ON p_partkey = k""",
    ),
    "mixed_up_people": (
        _mixed,
        f"""WITH {PEOPLE}, k AS (SELECT doc_id % 120 + 1 AS id, CASE WHEN doc_id % 3 <> 0 THEN 1 + doc_id % 3 END AS s, doc_id % 5 = 0 AS na, CASE WHEN doc_id % 2 = 0 THEN trim(source) END AS x, doc_id AS pos FROM documents),
  a AS (SELECT id, coalesce(max(s), 2)::INT AS severity, bool_or(na) AS none_after FROM k GROUP BY id), n AS (SELECT id, string_agg(x, ' — ' ORDER BY pos) AS note FROM (SELECT id, x, min(pos) AS pos FROM k WHERE x <> '' GROUP BY id, x) GROUP BY id)
  SELECT p.id, a.id IS NOT NULL AS mixed_up, a.severity, a.none_after, CASE WHEN a.id IS NOT NULL THEN coalesce(left(n.note, 1000), '') END AS note FROM p LEFT JOIN a USING (id) LEFT JOIN n USING (id)""",
    ),
    "unique_ids": (
        lambda s, d: etl.unique_ids(td.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("id")), ["o_orderkey"]),
        "SELECT o_orderkey, o_custkey || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)",
    ),
    "scholar_quotes": (
        _quotes,
        f"WITH {PEOPLE} SELECT doc_id % 150 AS person, coalesce(n_name, 'Alem ' || doc_id % 30) AS scholar, trim(left(text, 40)) AS text FROM documents JOIN p ON p.id = doc_id % 150 LEFT JOIN nation ON n_nationkey = doc_id % 30 WHERE trim(left(text, 40)) <> ''",
    ),
    "chain_export": (
        _export,
        f"""WITH {TEXTS}, {PEOPLE}, {CHAINS}, l AS (SELECT text_id AS id, string_agg(step || ':' || coalesce(term, '-') || ':' || a.name || ':' || b.name, '|' ORDER BY step) AS links FROM c JOIN p a ON a.id = student JOIN p b ON b.id = sheikh GROUP BY text_id)
  SELECT id, book, number, left(matn, 400) AS head, coalesce(links, '') AS links FROM t LEFT JOIN l USING (id) WHERE contains(book, 'src1') OR contains(book, 'src2')""",
    ),
    "rule_report": (_report, " UNION ALL ".join(f"SELECT *, {k} AS rule FROM ({_on_routes(ORACLES[r])})" for k, r in enumerate(RULE_ORDER))),
    "findings_by_type": (
        lambda s, d: compare.by_type(_two_rules(s, d), TYPES),
        f"SELECT *, 1 AS place FROM ({MASKING}) UNION ALL SELECT *, 0 FROM ({ORACLES['rule_raf_waqf']})",
    ),
    "edge_decorations": (
        _on_edges,
        f"""WITH f AS (SELECT * FROM ({MASKING}) UNION ALL SELECT * FROM ({ORACLES['rule_hidden_break']})), x AS (SELECT gid, split_part(people, ',', 1) AS student, split_part(people, ',', 2) AS sheikh, type, severity, confidence FROM f)
  SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY gid, student, sheikh ORDER BY severity DESC, confidence DESC, type) = 1""",
    ),
    "verification_metrics": (
        _cases,
        """WITH k AS (SELECT l_returnflag AS grp, ['not-found', 'exact', 'variant'][l_linenumber % 3 + 1] AS e, ['not-found', 'exact', 'variant'][l_suppkey % 3 + 1] AS g, l_quantity AS ms FROM lineitem)
  SELECT grp, count(*) AS cases, count(*) FILTER (e = g) AS passed, count(*) FILTER (e = 'not-found' AND g <> 'not-found') AS false_attributions, count(*) FILTER (e <> 'not-found' AND g = 'not-found') AS abstained, median(ms) AS median_ms FROM k GROUP BY ROLLUP (grp)""",
    ),
    "edge_flags": (_flags, f"WITH {LINKS}, {GROUPS} SELECT sheikh, student, bool_or(term = 'heard') AS flag, string_agg(DISTINCT book, ',' ORDER BY book) AS books FROM e JOIN g USING (text_id) GROUP BY sheikh, student"),
    "grades_with_defects": (
        _defects,
        f"""WITH {GROUPS}, s AS (SELECT gid, bool_and(h) AS every, bool_or(h) AS any_h FROM (SELECT gid, gid % 3 = 0 OR (text_id % 2 = 0 AND gid % 3 = 1) AS h FROM g) GROUP BY gid)
  SELECT gid, CASE WHEN every AND grade <> 'موضوع / متروك' THEN 'ضعيف (معلول)' ELSE grade END AS grade, coalesce(any_h AND NOT every, false) AS warned FROM ({ORACLES['structural_grade']}) LEFT JOIN s USING (gid)""",
    ),
    "routes_by_companion": (
        _companions,
        f"""WITH {CHAINS}, {GROUPS}, o AS (SELECT DISTINCT gid, sheikh AS person, step, text_id FROM c JOIN g USING (text_id)), tips AS (SELECT * FROM o QUALIFY step = max(step) OVER (PARTITION BY gid, text_id)),
  per AS (SELECT gid, text_id, person AS companion FROM (SELECT gid, text_id, person, count(*) AS n FROM tips GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gid, text_id ORDER BY n DESC, person) = 1),
  m AS (SELECT gid, companion AS main FROM (SELECT gid, companion, count(*) AS n, min(text_id) AS f FROM per GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY gid ORDER BY n DESC, f) = 1)
  SELECT gid, text_id, companion, companion <> main AS is_witness FROM per JOIN m USING (gid)""",
    ),
    "varying_edges": (_varying, f"WITH {CHAINS}, {GROUPS} SELECT gid, step, student, sheikh, step = 1 AND bool_or(text_id % 5 = 0) AS varies FROM c JOIN g USING (text_id) GROUP BY gid, step, student, sheikh"),
    "gathered_texts": (
        lambda s, d: graph.gathered(td.texts(s, d).where("id % 50 = 0"), catalog._related(s, d)),
        f"SELECT doc_id AS gid, doc_id AS text_id FROM documents WHERE doc_id % 50 = 0 UNION SELECT of, id FROM ({ORACLES['related_texts']})",
    ),
    "people_search": (
        lambda s, d: catalogue.find_people(td.people(s, d).withColumn("known_as", F.col("residence")), "NATION_1").select("id", "name", "known_as"),
        f"WITH {PEOPLE} SELECT id, name, residence AS known_as FROM p WHERE contains(name, 'NATION_1') OR contains(residence, 'NATION_1') ORDER BY id LIMIT 50",
    ),
    "people_in_graph": (
        lambda s, d: catalogue.find_in_graph(td.people(s, d).withColumn("norm", F.lower(F.concat_ws(" ", "residence", "region"))), F.lit("as na")),
        f"""WITH {PEOPLE}, f AS (SELECT id, name, lower(residence || ' ' || region) AS norm FROM p)
  SELECT id, name, (CASE WHEN starts_with(norm, 'as na') THEN 0 WHEN contains(norm, 'as na') THEN 1 WHEN contains(norm, ' as') THEN 2 ELSE 3 END)::INT AS place FROM f WHERE contains(norm, 'as') AND contains(norm, 'na') ORDER BY place, length(name), id LIMIT 8""",
    ),
    "registry_statistics": (
        _registry,
        f"""{HEARD}, {PEOPLE}, k AS (SELECT region AS source, (SELECT count(*) FROM rel WHERE rel.student = p.id) AS t, (SELECT count(*) FROM rel WHERE teacher = p.id) AS s, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS q FROM p)
  SELECT source, count(*) AS entries, avg(t) AS teachers, avg(s) AS students, avg(q) AS quotes FROM k GROUP BY ROLLUP (source)""",
    ),
    "gathering_summary": (
        _summary,
        f"""WITH {GROUPS}, o AS (SELECT gid, count(DISTINCT text_id) AS sources, count(DISTINCT book) AS books, count(DISTINCT CASE WHEN is_witness THEN text_id END) AS witnesses FROM ({ORACLES['witness_flags']}) JOIN g USING (gid, text_id) GROUP BY gid),
  f AS (SELECT gid, count(*) AS findings FROM ({MASKING}) WHERE NOT (severity = 0 AND confidence < 0.3) GROUP BY gid) SELECT gid, sources, books, witnesses, coalesce(findings, 0) AS findings FROM o LEFT JOIN f USING (gid)""",
    ),
    "places_apart": (
        _apart,
        f"""WITH {PEOPLE}, {LINKS}, k AS (SELECT id, list_transform(CASE WHEN id % 5 = 0 AND residence <> 'NATION_5' THEN [residence, 'NATION_5'] ELSE [residence] END, lambda x: trim(lower(x))) AS a FROM p),
  r AS (SELECT id, a, list_transform(a, lambda x: CASE WHEN x IN ('nation_0', 'nation_5', 'nation_10') THEN 'south' WHEN x IN ('nation_1', 'nation_6', 'nation_11') THEN 'west' ELSE x END) AS b FROM k)
  SELECT DISTINCT student, sheikh, array_to_string(x.a, '|') AS places, NOT list_has_any(x.a, y.a) AND NOT list_has_any(x.b, y.b) AS apart FROM e JOIN r x ON x.id = student JOIN r y ON y.id = sheikh""",
    ),
    "request_ids": (
        _ids,
        """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_custkey = o_orderkey THEN o_custkey::VARCHAR ELSE o_custkey || ',' || o_orderkey END AS ids, o_orderkey % 9 <> 0 AS valid FROM orders""",
    ),
    "reciprocity": (
        _reciprocity,
        f"""WITH {PEOPLE}, {CHAINS}, i AS (SELECT DISTINCT student AS owner, 'teachers' AS side, sheikh % 40 AS item FROM c WHERE student % 3 <> 0 UNION SELECT DISTINCT sheikh, 'students', student % 40 FROM c WHERE sheikh % 4 <> 0),
  r AS (SELECT i.*, p.id FROM i JOIN p ON p.id % 40 = item AND p.id <> owner), b AS (SELECT r.*, EXISTS (SELECT 1 FROM r q WHERE q.owner = r.id AND q.id = r.owner AND q.side <> r.side) AS back FROM r),
  k AS (SELECT i.side, count(b.id) AS n, count(*) FILTER (back) AS m FROM i LEFT JOIN b USING (owner, side, item) GROUP BY i.owner, i.side, i.item)
  SELECT side, CASE WHEN n = 0 THEN 'unresolved' WHEN m = 1 THEN 'confirmed' WHEN n = 1 THEN 'unique' WHEN m > 1 THEN 'several' ELSE 'ambiguous' END AS status, count(*) AS n FROM k GROUP BY ALL""",
    ),
    "without_opener": (
        _opened,
        f"""{HEARD}, fm AS (SELECT teacher AS id, count(*) AS fame FROM rel GROUP BY teacher), n AS (SELECT l_orderkey AS text_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS pos, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END AS id FROM lineitem),
  h AS (SELECT n.*, a.fame AS f1, b.fame AS f2, id % 50 + 1 AS id2 FROM n LEFT JOIN fm a USING (id) LEFT JOIN fm b ON b.id = n.id % 50 + 1 WHERE pos < 2 AND pos = text_id % 3 AND n.id IS NOT NULL),
  x AS (SELECT * FROM (SELECT text_id, id AS compiler FROM h) JOIN n USING (text_id) LEFT JOIN fm USING (id) WHERE pos < 2 AND n.id IS NOT NULL AND compiler IN (id, id % 50 + 1)),
  cut AS (SELECT text_id, min(pos) AS cut FROM (SELECT x.*, coalesce(fame, 0) AS f1, coalesce((SELECT fame FROM fm WHERE fm.id = x.id % 50 + 1), 0) AS f2 FROM x)
    WHERE CASE WHEN f1 > f2 OR (f1 = f2 AND id <= id % 50 + 1) THEN id ELSE id % 50 + 1 END = compiler OR (id % 9 = 3 AND compiler IN (SELECT s_suppkey FROM supplier)) GROUP BY text_id)
  SELECT text_id, pos - coalesce(cut, -1) - 1 AS pos, 'n' || coalesce(id, 0) % 9 AS name FROM n LEFT JOIN cut USING (text_id) WHERE pos > coalesce(cut, -1)""",
    ),
    "candidates_by_words": (
        _by_words,
        """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, list_append(string_split(p_name, ' '), lower(p_type)) AS a FROM part),
  n AS (SELECT id AS name_id, CASE WHEN id % 2 = 0 THEN w ELSE [w[2], a[len(a)]] END AS nw FROM p JOIN supplier ON s_suppkey = id),
  h AS (SELECT name_id, id, list_has_all(w, nw) AND w[1] = nw[1] AS main FROM n JOIN p ON list_has_all(a, nw))
  SELECT name_id, id, (CASE WHEN main THEN 0 ELSE 1 END)::INT AS tier FROM (SELECT *, bool_or(main) OVER (PARTITION BY name_id) AS any_main FROM h) WHERE main OR NOT any_main""",
    ),
    "reference_cards": (
        _cards,
        f"""WITH {GROUPS}, k AS (SELECT gid, book, text_id, o_custkey AS number FROM g JOIN orders ON o_orderkey = text_id)
  SELECT gid, book, array_to_string(list_sort(list(DISTINCT number)), ',') AS numbers, count(DISTINCT text_id) AS texts FROM k GROUP BY gid, book""",
    ),
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
