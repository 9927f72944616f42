from pyspark.sql import functions as F

from corpusloom.functions.text import LATIN
from corpusloom.operators import etl, graph, resolve, rules, search, variation
from corpusloom.operators.graph import _paths
from corpusloom.sources import readers, sinks
from corpusloom.streaming.limits import counted, limited

EDGES = [(1, 1, 10, 20, "heard"), (1, 2, 20, 30, "from"), (1, 2, 20, 31, None), (1, 3, 31, 40, "from")]


def links(spark, rows=EDGES):
    return spark.createDataFrame(rows, "text_id long, step int, student long, sheikh long, term string")


def people(spark, ranks):
    rows = [(i, f"n{i}", "x", "y", r, 10, 80, "3", None, False, None, False) for i, r in ranks.items()]
    return spark.createDataFrame(rows, "id long, name string, residence string, region string, rank int, birth int, death int, generation string, tadlis_tier int, mixed_up boolean, severity int, none_after boolean")


def test_tree_and_paths(spark):
    t = {tuple(r) for r in graph.tree(links(spark), people(spark, {10: None, 20: 3, 30: 1, 31: 2, 40: 1})).collect()}
    assert (1, 0, 10, None, None) in t and (1, 3, 40, 31, "companion") in t and len(t) == 5
    assert {r.path for r in graph.paths(links(spark)).collect()} == {"10>20>30", "10>20>31>40"}
    wide = [(s, a, b) for s in range(1, 7) for a in (s * 10, s * 10 + 1) for b in (s * 10 + 10, s * 10 + 11)]
    found = _paths(wide, 16)
    assert len(found) == 16 and all(len(set(p)) == len(p) for p in found)
    assert _paths([(2, 1, 2)], 16) == []


def test_weakest_and_grade(spark):
    p = people(spark, {20: 3, 30: 7, 31: None, 40: 1})
    w = graph.weakest(links(spark, [(1, 1, 10, 20, None), (1, 2, 20, 30, None), (2, 1, 10, 31, None)]), p)
    assert {(r.text_id, r.weakest, r.tier, r.unrated) for r in w.collect()} == {(1, 30, 7, 0), (2, None, None, 1)}
    groups = spark.createDataFrame([(1, 5), (2, 6)], "text_id long, gid long")
    assert {(r.gid, r.grade) for r in rules.structural_grade(w, groups).collect()} == {(5, rules.WEAK), (6, rules.UNSETTLED)}
    g = rules.structural_grade(w, groups)
    src = spark.createDataFrame([(5, 1, True), (6, 2, False)], "gid long, text_id long, harmful boolean")
    assert {(r.gid, r.grade) for r in rules.with_defects(g, src).collect()} == {(5, rules.WEAK_BY_DEFECT), (6, rules.UNSETTLED)}


def test_chain_links(spark):
    rows = [(1, 9, [[(1, ["heard"]), (1, ["from"]), (None, None), (2, ["from", "heard", "said"]), (3, [])], [(1, ["from"])]])]
    r = spark.createDataFrame(rows, "text_id long, compiler long, branches array<array<struct<id:long,verbs:array<string>>>>")
    assert {tuple(x) for x in etl.build_links(r, LATIN).collect()} == {(1, 1, 9, 1, None), (1, 2, 2, 3, "heard")}


def test_relations_hearings_and_people(spark):
    lists = spark.createDataFrame([(1, [2, 1, 99], [3]), (3, [1], [])], "id long, teachers array<long>, students array<long>")
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {tuple(x) for x in etl.relations(lists, known).collect()} == {(2, 1), (1, 3)}
    claims = lambda *c: [{"timing": t, "quote": q, "book": b} for t, q, b in c]
    rows = [(1, 2, 0, 2, claims((0, "a", "x"), (2, "b", "y"))), (1, 2, 1, 1, claims((1, "c", "x"))), (1, 1, 0, 1, claims((1, "d", "x"))), (1, 3, 0, 1, claims((2, "e", "x"), (0, "f", "y"))), (1, 4, 0, 1, [])]
    hearings = spark.createDataFrame(rows, "sheikh long, student long, pos int, timing int, claims array<struct<timing:int,quote:string,book:string>>")
    names = spark.createDataFrame([("y", "Book of Y")], "book string, name string")
    want = [(1, 2, 2, "b", "y"), (1, 3, 1, "e", "x"), (1, 4, 1, None, None)]
    assert sorted(tuple(x) for x in etl.first_hearings(hearings).collect()) == want
    assert {(x.student, x.book) for x in etl.first_hearings(hearings, names).collect()} == {(2, "Book of Y"), (3, "x"), (4, None)}
    assert [x.c for x in spark.createDataFrame([("both",), ("conflict",), ("Both",), (None,)], "t string").select(etl.timing_code(F.col("t")).alias("c")).collect()] == [3, 4, 0, 0]
    assert readers.read(spark, "seed").count() == 2
    got = etl.people(readers.read(spark, "seed")).collect()
    assert [(r.id, r.kunya) for r in sorted(got)] == [(1, "أبو عمر"), (2, None)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "registry.json").write_text('[{"id": 1, "name": "a", "quotes": [{"critic": " ", "via": "v", "text": "t"}]}]')
    reg = readers.read(spark, str(tmp_path / "registry.json"))
    assert [(r.scholar, r.text) for r in etl.evaluations(reg, "s").collect()] == [("غير منسوب", "t (رواية: v)")]
    (tmp_path / "chains").mkdir()
    (tmp_path / "chains/a.json").write_text('{"book": "b", "compiler": 7, "chains": [{"text_id": 1, "branches": [[{"id": 2, "verbs": ["heard"]}]]}]}')
    (tmp_path / "chains/_x.json").write_text('{"book": "c", "compiler": 7, "chains": [{"text_id": 2, "branches": []}]}')
    assert [tuple(r) for r in etl.build_links(readers.read(spark, str(tmp_path / "chains/*.json")), LATIN).collect()] == [(1, 1, 7, 2, None)]
    (tmp_path / "p.tsv").write_text("b-1\t1 - one\\n2 - two\nbad\tx\n")
    pages = readers.read(spark, str(tmp_path / "p.tsv"))
    assert [(r.number, r.text) for r in readers.numbered_records(pages).collect()] == [(1, "one"), (2, "two")]
    root = str(tmp_path / "db")
    assert sinks.write_all({"a": spark.range(3), "b": spark.range(2)}, root) == {"a": 3, "b": 2}
    assert sinks.write_all({"a": spark.range(5)}, root) == {"a": 5} and spark.read.parquet(f"{root}/a").count() == 5
    assert sinks.write_all({}, root) == {}
    for source, n in (("x", 3), ("y", 2), ("x", 1)):
        sinks.replace_source(spark.range(n), f"{root}/r", source)
    assert {(r.source, r["count"]) for r in spark.read.parquet(f"{root}/r").groupBy("source").count().collect()} == {("x", 1), ("y", 2)}
    assert sinks.upserted(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), "k").count() == 2


def test_search_plan_and_page(spark):
    assert search.plan(must=[" ", ""]) is None
    assert search.plan(query="x", operator="or").any_of == ("x",) and search.plan(must=["a"], query="b").must == ("a",)
    assert search.plan(must=["a"], page_size=999).page_size == 200
    t = spark.createDataFrame([(1, 1, "one two", "one two", "b", "c", "i"), (2, 2, "two x one", "two x one", "b", "c", None), (3, 3, "zzz", "zzz", "b", "c", None)], "id long, number long, matn string, norm string, book string, chapter string, isnad string")
    got = search.search(t, search.Request(("one two",)), LATIN).collect()
    assert [(r.id, r.exact) for r in got] == [(1, True), (2, False)] and got[0].relevance == 100
    assert [r.id for r in search.candidates(t, search.Request(("two", "one"), ordered=True)).collect()] == [2]


def test_resolution():
    edge = lambda a, b: {(1, 2): 1, (2, 5): 2, (1, 3): 1}.get((a, b), 0)
    fame = lambda j: {2: 9, 3: 2}.get(j, 1)
    assert resolve.decide([[1], [2, 3], [5]], None, edge, fame) == [(1, "unique"), (2, "chain"), (5, "unique")]
    assert resolve.decide([[1], [2, 3]], None, edge, fame) == [(1, "unique"), (2, "chain_fame")]
    assert resolve.decide([[], [7, 8]], None, edge, fame) == [(None, "missing"), (None, "ambiguous")]


def test_at_split():
    b = lambda s, t, text, ranked=True: {"student": s, "tier": t, "ranked": ranked, "tokens": text.split()}
    base = "one two three four five six seven"
    assert variation.at_split([b(1, 2, base), b(2, 2, base)]) == []
    assert variation.at_split([b(1, 2, base), b(2, 2, base + " x y z")])[0][:3] == ("addition", rules.HARMLESS, 0.6)
    assert variation.at_split([b(1, 2, base), b(2, 8, base + " x y z")])[0][:3] == ("rejected", rules.HARMFUL, 0.6)


def test_limits(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    assert limited(rows).where("allowed").count() == 10
    rows.write.parquet(str(tmp_path / "in"))
    stream = counted(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("lim").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [(r.requests, r.allowed, r.refused) for r in spark.table("lim").collect()][-1] == (25, 10, 15)


def test_verdicts_as_cases(spark):
    """Stems, denial, ties by length, and inputs that aren't looked up."""
    from corpusloom.functions.text import ARABIC
    from corpusloom.operators import verify

    texts = spark.createDataFrame([(1, "انما الاعمال بالنيات وانما لكل امرئ ما نوى"), (2, "انما الاعمال بالنيات وانما لكل امرئ ما نوى فمن كانت هجرته"), (3, "لا يؤمن احدكم حتى يحب لاخيه ما يحب لنفسه"), (4, "من غشنا فليس منا")], "id long, matn string")
    given = [(1, "إنما الأعمال بالنيات وإنما لكل امرئ ما نوى"), (2, "يؤمن أحدكم حتى يحب لأخيه ما يحب لنفسه"), (3, "لا انما الاعمال بالنيات وانما لكل امرئ ما نوى"), (4, "كلمتان فقط"), (5, "شيء اخر ليس في المتون كلها"), (6, "س " * 400), (7, "احدكم حتى يحب اخيه ما يحب نفسه"), (8, None)]
    got = {r.input_id: r for r in verify.verdicts(spark.createDataFrame(given, "input_id long, text string"), texts, ARABIC).collect()}
    assert got[1].status == "exact" and got[1].best == 1 and not got[1].negated
    assert got[2].status == "exact" and got[2].best == 3
    assert got[3].negated and got[3].status == "not-found" and got[3].best == 1
    assert [got[k].status for k in (4, 5, 6, 8)] == ["invalid", "not-found", "invalid", "invalid"]
    assert got[7].status == "exact"  # joined letters don't count


def test_same_person_of_one_name(spark):
    """A name that all have makes no pairs: only its years meet."""
    from corpusloom.operators import etl

    mine = spark.range(30000).selectExpr("id", "'n' AS name", "CASE WHEN id % 3 = 0 THEN NULL ELSE 100 + id % 50 END AS death")
    theirs = spark.range(30000).selectExpr("id AS other", "'n' AS name", "CASE WHEN id % 4 = 0 THEN NULL ELSE 110 + id % 60 END AS death")
    got = {r.other: r.id for r in etl.same_person(mine.where("id <> 0 AND (id % 3 <> 0 OR id > 600)"), theirs).collect()}
    year = {i: 100 + i % 50 for i in range(1, 30000) if i % 3}
    for o in (0, 1, 7, 59):
        d = 110 + o % 60
        near = [i for i in range(1, 30000) if (i in year or i > 600) and (o % 4 == 0 or i not in year or abs(year[i] - d) <= 5)]
        assert got[o] == min(near)
    assert len(got) == 30000
