"""Registry of the queries over the driver's tables: each wires one operator to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alignment import aligned_column
from ..functions.scoring import cluster_column, relevance_column
from ..functions.text import LATIN, comparable, query_terms, words
from ..operators import catalogue, compare, etl, graph, resolve, rules, search, variation, verify
from ..sources import testdata as td
from ..streaming.limits import limited
from .oracles import ORACLES

TRUSTED = ("BUILDING",)
Query = Callable[[SparkSession, str], DataFrame]


def _found(must=(), any_of=(), without=(), match="all", scope="all", **rest) -> Query:
    r = search.Request(tuple(must), tuple(any_of), tuple(without), scope=scope, match=match, **rest)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = search.candidates(td.texts(spark, sf), r) if r.ordered or r.within else td.texts(spark, sf).where(search.predicate(r))
        return found.select("id", "book", "number", F.length("norm").alias("n"))

    return run


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return td.books_of_texts(spark, sf).select("text_id", F.floor(F.col("text_id") / 30).alias("gid"), "book")


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    return td.chains(spark, sf).join(_groups(spark, sf), "text_id").withColumn("raised", F.col("text_id") % 3 == 0)


def _evaluations(spark: SparkSession, sf: str) -> DataFrame:
    camp = F.when(F.col("toxic") == 1, "blame").when(F.col("quality") == 1, "praise")
    d, labels = td.table(spark, sf, "documents").select("doc_id", "source"), td.table(spark, sf, "labels")
    return d.join(labels, "doc_id").select((F.col("doc_id") % 100 + 1).alias("person"), F.col("source").alias("scholar"), camp.alias("camp"), F.coalesce(camp, F.lit("none")).alias("verdict"))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return td.table(spark, sf, "benchmark").select(F.col("item_id").alias("input_id"), "text")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of chains: the lines of an order, every seventh person undecided."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    verb = F.when(F.col("l_returnflag") == "R", "heard").otherwise("from")
    return td.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("text_id"), (F.row_number().over(w) - 1).alias("pos"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("id"), verb.alias("verb"))


def _masking(spark, sf):
    return rules.masking(_chains(spark, sf), td.people(spark, sf), TRUSTED, LATIN)


def _weakest(spark, sf):
    return graph.weakest(td.chains(spark, sf), td.people(spark, sf))


def _mixing_up(spark, sf):
    c = _chains(spark, sf)
    hearings = c.select("sheikh", "student").distinct().withColumn("timing", ((F.col("sheikh") + F.col("student")) % 5).cast("int"))
    return rules.mixing_up(c, td.people(spark, sf), hearings, TRUSTED)


def _tooltip(spark, sf):
    return catalogue.tooltip(td.people(spark, sf), _evaluations(spark, sf))


def _detail(spark, sf):
    out = catalogue.details(td.people(spark, sf), _evaluations(spark, sf))
    return out.select("id", "name", "rank", F.array_join(F.transform("evaluations", lambda e: F.concat(e.scholar, F.lit("="), e.verdict)), ",").alias("evaluations"))


def _ranks(spark, sf):
    w = Window.partitionBy("input_id").orderBy(F.col("similarity").desc(), "id")
    m = verify.containments(_inputs(spark, sf), td.texts(spark, sf), LATIN).withColumn("r", F.row_number().over(w))
    best = m.where("similarity >= 0.95").groupBy("input_id").agg(F.min("r").alias("rank"))
    return resolve.retrieval_metrics(_inputs(spark, sf).join(best, "input_id", "left"))


def _links(spark, sf):
    n = _names(spark, sf).groupBy("text_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "verb"))), lambda x: F.struct(x.id.alias("id"), F.array(x.verb).alias("verbs"))).alias("names"))
    return etl.build_links(n.select("text_id", F.lit(0).alias("compiler"), F.array("names").alias("branches")), LATIN)


def _relations(spark, sf):
    c = td.chains(spark, sf)
    lists = c.where("term = 'heard'").groupBy(F.col("student").alias("id")).agg(F.collect_set("sheikh").alias("teachers"), F.array().cast("array<bigint>").alias("students"))
    lists = lists.unionByName(c.where("term = 'from'").groupBy(F.col("sheikh").alias("id")).agg(F.array().cast("array<bigint>").alias("teachers"), F.collect_set("student").alias("students")))
    return etl.relations(lists, td.people(spark, sf))


def _strict(spark, sf):
    c = td.chains(spark, sf).select(F.col("student").alias("owner"), (F.col("text_id") % 1000).alias("item"), F.col("sheikh").alias("id"))
    back = td.relations(spark, sf).select(F.col("teacher").alias("id"), F.col("student").alias("owner"))
    return resolve.strict(c, back)


def _fame(spark, sf):
    p = td.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).alias("key"), F.col("p_partkey").alias("id"), F.col("p_size").alias("fame"))
    return resolve.clearly_first(p, ["key"])


def _pairs(spark, sf):
    """Texts of one book next to each other, as words."""
    t = td.texts(spark, sf).select("id", "book", words(comparable(F.col("matn"), LATIN)).alias("w"))
    w = Window.partitionBy("book").orderBy("id")
    return t.withColumn("b", F.lead("w").over(w)).withColumn("other", F.lead("id").over(w)).where("other IS NOT NULL")


def _aligned(spark, sf):
    a = _pairs(spark, sf).withColumn("x", aligned_column(F.col("w"), F.col("b")))
    return a.select("id", "other", "x.similarity", "x.kind", F.size("x.segments").alias("n_segments"))


def _bodies(spark, sf):
    t = td.texts(spark, sf).select((F.floor(F.col("id") / 10)).alias("gid"), F.col("id").alias("ord"), F.col("id").alias("text_id"), words(comparable(F.col("matn"), LATIN)).alias("tokens"))
    return variation.group_variants(t)


def _numbered(ids: DataFrame, key: str, cell: int = 4096) -> DataFrame:
    """The distinct numbers in key with their place from 0 on as n: places are counted within cells of
    the range, so only the sizes of the cells meet in one task."""
    d = ids.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_cell", F.floor(F.col(key) / cell))
    sizes = d.groupBy("_cell").agg(F.count("*").alias("_size"))
    before = sizes.select("_cell", (F.sum("_size").over(Window.orderBy("_cell")) - F.col("_size")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    return d.join(before, "_cell").select(key, place.alias("n"))


def _at_split(spark, sf):
    """The k-th text of a branch has the words of the k-th document, from the first again after the last."""
    c, p = _chains(spark, sf), td.people(spark, sf)
    t = td.texts(spark, sf).select(F.col("id").alias("doc"), words(comparable(F.col("matn"), LATIN)).alias("tokens"))
    first = c.groupBy("gid", "sheikh", "student").agg(F.min("text_id").alias("ord"))
    many = first.groupBy("gid", "sheikh").count().where("count >= 2").drop("count")
    first = first.join(many, ["gid", "sheikh"])
    docs = _numbered(t, "doc")
    given = _numbered(first, "ord").crossJoin(F.broadcast(docs.agg(F.count("*").alias("of")))).select("ord", (F.col("n") % F.col("of")).alias("n")).join(docs, "n").join(t, "doc").select("ord", "tokens")
    b = first.join(given, "ord").join(p.select(F.col("id").alias("student"), F.coalesce("rank", F.lit(7)).alias("tier"), F.col("rank").isNotNull().alias("ranked")), "student")
    return variation.text_at_split(b.select("gid", "sheikh", "ord", "student", "tier", "ranked", "tokens"))


def _viterbi(spark, sf):
    n = _names(spark, sf).select("text_id", "pos", F.when(F.col("id").isNotNull(), F.array("id", F.col("id") % 50 + 1, F.col("id") % 30 + 1)).otherwise(F.array().cast("array<bigint>")).alias("candidates"))
    rel = td.relations(spark, sf).withColumn("weight", F.lit(1))
    fame = td.relations(spark, sf).groupBy(F.col("teacher").alias("id")).agg(F.count("*").alias("fame"))
    return resolve.resolve_chains(n, rel, fame)


def _focus(spark, sf):
    e = td.links(spark, sf)
    return graph.reachable(e, e.groupBy("text_id").agg(F.min("sheikh").alias("person")))


def _related(spark, sf):
    t = td.texts(spark, sf)
    ids = t.where("id % 50 = 0").select("id")
    given = t.join(ids, "id", "left_semi")
    return search.related_to(t, given)


def _search_ranked(spark, sf):
    return search.search(td.texts(spark, sf), search.Request(("there anti",), match="all"), LATIN)


def _shifted(spark, sf):
    """The same chains, every fifth person unknown and every eleventh text moved on by a place."""
    n = _names(spark, sf).select("text_id", "pos", "id")
    other = n.select("text_id", (F.col("pos") + (F.col("text_id") % 11 == 0).cast("int")).alias("pos"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("id"))
    return n, other


def _symbols(spark, sf):
    part = td.table(spark, sf, "part")
    c = part.select(F.col("p_size").alias("item"), F.col("p_partkey").alias("id"), F.split(F.element_at(F.split("p_brand", "#"), -1), "").alias("own"))
    return resolve.by_symbols(c.withColumn("need", F.array((F.col("item") % 5 + 1).cast("string"))), ["item"]).select("item", "id")


def _anomalies(spark, sf):
    nation, region = td.table(spark, sf, "nation"), td.table(spark, sf, "region")
    regions = {r[0].lower(): r[1] for r in nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name").collect()}
    died = F.when(F.col("id") % 4 == 0, F.concat(F.lit("NATION_"), F.col("id") % 25))
    return graph.anomalies(td.links(spark, sf), td.people(spark, sf).withColumn("death_place", died), regions, lex=LATIN)


def queries() -> dict[str, Query]:
    from . import linked, more, people

    t, p, e, c, g = td.texts, td.people, td.links, td.chains, _groups
    return more.queries() | linked.queries() | people.queries() | {
        "normalize_text": lambda s, d: t(s, d).select("id", "norm", F.size(query_terms(F.col("matn"), LATIN)).alias("n_terms")),
        "search_all_words": _found(["there anti"]),
        "search_any_word": _found(["thanedble eneau"], match="any"),
        "search_exact": _found(["of the "], match="exact", scope="matn"),
        "search_not": _found(["the "], without=["anti"], match="exact", scope="matn"),
        "search_and_or": _found(["en"], ["ereau", "thhe"], scope="matn"),
        "search_scope_all": _found(["src1"]),
        "search_ordered": _found(["the ", "ing"], scope="matn", ordered=True),
        "search_proximity": _found(["the ", "ing"], scope="matn", within=5),
        "search_ranked": _search_ranked,
        "books": lambda s, d: catalogue.books(t(s, d)),
        "chapters_by_min": lambda s, d: catalogue.chapters(t(s, d), "src1"),
        "chapter_items": lambda s, d: catalogue.items(t(s, d), "src1", "en"),
        "related_texts": _related,
        "narrator_detail": _detail,
        "narrator_tooltip": _tooltip,
        "consensus": lambda s, d: catalogue.consensus(_evaluations(s, d)),
        "chain_tree": lambda s, d: graph.tree(e(s, d), p(s, d)),
        "chain_anomalies": _anomalies,
        "merged_nodes": lambda s, d: graph.merged_nodes(e(s, d), g(s, d), p(s, d)),
        "merged_edges": lambda s, d: graph.merged_edges(e(s, d), g(s, d), p(s, d)),
        "all_paths_uncapped": lambda s, d: graph.paths(e(s, d), None),
        "all_paths_capped": lambda s, d: graph.paths(e(s, d)),
        "reachable": _focus,
        "split_points": lambda s, d: graph.split_points(c(s, d), g(s, d)),
        "main_companion": lambda s, d: graph.main_companion(c(s, d), g(s, d), p(s, d)),
        "witness_flags": lambda s, d: graph.witnesses(c(s, d), g(s, d), p(s, d)),
        "weakest_link": _weakest,
        "rule_tadlis": _masking,
        "rule_ikhtilat": _mixing_up,
        "rule_hidden_break": lambda s, d: rules.hidden_break(_chains(s, d), p(s, d), td.relations(s, d), LATIN),
        "rule_raf_waqf": lambda s, d: rules.raised_stopped(_chains(s, d), p(s, d)),
        "rule_wasl_irsal": lambda s, d: rules.joined_cut(_chains(s, d), p(s, d)),
        "rule_text_at_split": _at_split,
        "structural_grade": lambda s, d: rules.structural_grade(_weakest(s, d), g(s, d)),
        "finding_counts": lambda s, d: rules.counts(_masking(s, d)),
        "verify_containment": lambda s, d: verify.containments(_inputs(s, d), t(s, d), LATIN),
        "verify_status": lambda s, d: verify.verdicts(_inputs(s, d), t(s, d), LATIN).select("input_id", "similarity", "best", "status"),
        "verify_words": lambda s, d: verify.verdicts(_inputs(s, d), t(s, d), LATIN).select("input_id", "best", "unmatched", "negated"),
        "fame_pick": _fame,
        "symbol_filter": _symbols,
        "chain_changes": lambda s, d: compare.changes(*_shifted(s, d)),
        "chain_agreement": lambda s, d: compare.agreement(*_shifted(s, d)),
        "severity_pivot": lambda s, d: compare.severity_pivot(_masking(s, d).unionByName(rules.raised_stopped(_chains(s, d), p(s, d)))),
        "strict_relations": _strict,
        "trigram_match": lambda s, d: resolve.best_by_trigrams(_inputs(s, d).withColumnRenamed("input_id", "id"), t(s, d).withColumnRenamed("matn", "text")),
        "chain_report": lambda s, d: resolve.chain_report(_names(s, d).join(td.books_of_texts(s, d), "text_id"), p(s, d)),
        "retrieval_metrics": _ranks,
        "json_to_links": _links,
        "relations_dedup": _relations,
        "carry_down": lambda s, d: etl.carry_down(td.table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("value"), "carried").select("event_id", "user_id", "carried"),
        "rate_window": lambda s, d: limited(td.table(s, d, "events")),
        "relevance": lambda s, d: t(s, d).select("id", relevance_column(F.col("norm"), ["the", "anti", "of"], "of the", LATIN).alias("r")).select("id", "r.percent", "r.span"),
        "cluster_span": lambda s, d: t(s, d).select("id", cluster_column(F.col("norm"), F.col("isnad"), ["the", "anti"], False, "all").alias("r")).select("id", "r.valid", "r.span"),
        "align_lcs": _aligned,
        "medoid": _bodies,
        "viterbi_chain": _viterbi,
    }


def oracle_sql() -> dict[str, str]:
    from . import linked, more, people

    return dict(ORACLES) | more.oracle_sql() | linked.oracle_sql() | people.oracle_sql()
