"""Bodies, replies, places, loading transforms and reports by hand."""

from pyspark.sql import functions as F

from corpusloom.functions import places, replies
from corpusloom.functions.scoring import raw_index, raw_index_column
from corpusloom.functions.text import ARABIC, body_of, extract, snippet
from corpusloom.operators import catalogue, etl, graph, rules
from corpusloom.plans import catalog


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_body(spark):
    got = one(
        spark, body_of(F.lit("حدثنا زيد عن عمرو قال رسول الله صلى الله عليه وسلم من غشنا فليس منا [حكم: صحيح] رواه مسلم")), body_of(F.lit("حدثنا زيد عن عمرو بن سعد قال المسلم اخو المسلم لا يظلمه ولا يسلمه ابدا في كل حال")),
        body_of(F.lit("قال النبي الدين النصيحة وحدثنا زيد")), body_of(F.lit(None).cast("string")), body_of(F.lit("كلام بلا علامة")), extract(F.lit("x" * 5000), F.lit("x" * 5000), F.lit(0)), extract(F.lit("short"), F.lit("short"), F.lit(2)),
    )
    assert got[0] == "قال رسول الله من غشنا فليس منا" and got[1].startswith("قال المسلم اخو المسلم") and got[2] == "قال النبي الدين النصيحه"
    assert got[3] == "" and got[4] == "كلام بلا علامه" and got[5] == "x" * 4000 + " ..." and got[6] == "short"


def test_windows_follow_the_cluster_in_the_raw_text(spark):
    """The longest term where all terms are near, not the first of any; by proportion where marks make the raw text longer."""
    norm = "far " * 300 + "near " + "of " * 300 + "far near " + "end " * 200
    raw = norm.replace("a", "a\u0301")
    df = spark.createDataFrame([(raw, norm), ("short", "short"), ("x" * 200, "")], "matn string, norm string")
    at = raw_index_column(F.col("matn"), F.col("norm"), ["near", "far"])
    got = df.select(at.alias("at"), snippet(F.col("matn"), F.col("norm"), at).alias("s"), extract(F.col("matn"), F.col("norm"), at, 400, 50).alias("x"), snippet(F.col("matn"), F.col("norm"), None).alias("p")).collect()
    place = int(norm.index("near") / len(norm) * len(raw))
    assert got[0].at == place and got[0].s == "..." + raw[place - 60 : place + 120].strip() + "..." and got[0].x == "... " + raw[place - 50 : place + 350].strip() + " ..."
    assert got[0].p == raw[:150] + "..." and (got[1].s, got[1].x, got[1].p) == ("short",) * 3 and got[2].s == "x" * 150 + "..."
    far = "near " + "of " * 600 + "far near"
    assert raw_index(far, far, ["near", "far"]) == far.rindex("near") and raw_index(far, far, ["near", "none"]) == 0


def test_replies(spark):
    rows = spark.createDataFrame([("q", i, i * 10, "انما الاعمال بالنيات وانما لكل امرئ") for i in range(1, 6)] + [("e", 1, 7, "نص")], "request_id string, place int, id long, matn string")
    raw = """Sure: ```json [{"index":1,"level":"Direct ","quote":"إنما الأعمالُ بالنيات","reason":"r"},{"index":2,"level":"direct","quote":"انما الاعمال","reason":""},
      {"index":3,"level":"great","quote":"انما الاعمال بالنيات"},{"index":4,"level":"direct","quote":"ليس في النص ابدا"},{"index":5,"level":"direct","quote":"انما الاعمال بالنيات"},{"index":5,"level":"partial","quote":"انما الاعمال بالنيات"},{"index":9,"level":"direct","quote":"انما الاعمال بالنيات"}] ```"""
    got = replies.judged(spark.createDataFrame([("q", raw), ("e", "no json")], "request_id string, raw string"), rows)
    assert {(r.request_id, r.place): r.level for r in got.collect()} == {("q", 1): "direct", **{("q", k): None for k in range(2, 6)}, ("e", 1): None}
    assert {r.request_id: r.status for r in replies.page_status(got).collect()} == {"q": "partial", "e": "invalid"}
    texts = F.array(F.lit("هو ثقة ثبت"))
    assert one(spark, *[replies.tier_status(F.lit(t), F.lit(q), texts, ARABIC) for t, q in (("T12", "ثقة ثبت"), ("T13", "ثقة"), ("T1", "كذاب"), (None, "ثقة"))]) == ("ok", "unverified", "unverified", "unverified")


def test_places(spark):
    cities, regions = ("بغداد", "البصره", "واسط"), {"بغداد": "iraq", "البصره": "iraq"}
    of = lambda x: places.places_of(F.lit(x).cast("string"), cities, ("نزل", "سكن"))
    assert one(spark, of("سكن البصرة، وبغداد; واسط/واسط"), of(None)) == (["البصره", "بغداد", "واسط"], [])
    apart = lambda a, b: places.nothing_in_common(of(a), of(b), regions)
    assert one(spark, apart("بغداد", "البصرة"), apart("بغداد", "واسط"), apart("بغداد", None)) == (False, True, False)


def test_loading(spark):
    df = spark.createDataFrame
    assert {r.slug: r.book for r in etl.book_names(df([("a", "A"), ("b", "B")], "slug string, title string"), df([("a", "Name")], "slug string, name string")).collect()} == {"a": "Name", "b": "B"}
    got = etl.with_chapters(df([("x/1.json", None), ("x/2.json", "own"), ("x/3.json", None)], "file string, chapter string"), df([("1.json", " One "), ("2.json", "Two"), ("3.json", " ")], "file string, title string"))
    assert [r.chapter for r in got.orderBy("file").collect()] == ["One", "own", None]
    side = etl.exact_side_entries(df([("2", "b"), ("10", "c")], "side_id string, v string"), df([(1, "10", "exact"), (1, "2", "exact"), (2, "10", "near")], "id long, side_id string, confidence string"))
    assert [(r.id, r.v) for r in side.collect()] == [(1, "b")]
    entries = df([(1, [("c", None, "good", "B1"), (None, None, "bad", "B2"), ("c", None, " ", None)])], "id long, quotes array<struct<critic:string,via:string,text:string,book:string>>")
    assert [(r.person, r.text) for r in etl.side_evaluations(entries, "s", "B1").collect()] == [(1, "bad")]
    p = df([(1, True), (2, True)], "id long, mixed_up boolean")
    claims = df([(1, 1, False, "b", 2), (1, 3, None, "a", 1), (1, None, True, "b", 3), (1, None, None, " ", 4)], "id long, severity int, none_after boolean, text string, pos int")
    for _ in range(2):
        p = etl.mixed_up_claims(p, claims)
    got = {r.id: (r.mixed_up, r.severity, r.none_after, r.note) for r in p.collect()}
    assert got == {1: (True, 3, True, "a — b"), 2: (False, None, None, None)}
    assert sorted(r.id for r in etl.unique_ids(df([("a", 1), ("a", 2), ("b", 1)], "id string, o int"), ["o"]).collect()) == ["a", "a-2", "b"]


def test_people_and_summaries(spark):
    df = spark.createDataFrame
    people = df([(2, "abc def", None, "abc def"), (1, "x", "abc", "x abc"), (3, None, None, "zabc defz")], "id long, name string, known_as string, norm string")
    assert [r.id for r in catalogue.find_people(people, "abc").collect()] == [1, 2] and catalogue.find_people(people, "abc", 1).count() == 1
    assert {(r.id, r.place) for r in catalogue.find_in_graph(people, F.lit("abc")).collect()} == {(2, 0), (3, 1), (1, 1)}
    assert [(r.id, r.place) for r in catalogue.find_in_graph(people, F.lit("x  abc")).collect()] == [(1, 2)] and catalogue.find_in_graph(people, F.lit(" ")).count() == 0
    st = catalogue.registry_statistics(df([("s", [1, 2], [], None), ("t", None, [1], [])], "source string, teachers array<int>, students array<int>, quotes array<int>"))
    assert {r.source: (r.entries, r.teachers) for r in st.collect()} == {None: (2, 1.0), "s": (1, 2.0), "t": (1, 0.0)}
    src = df([(1, 1, "a", False), (1, 2, "a", True), (2, 3, "b", False)], "gid long, text_id long, book string, is_witness boolean")
    found = df([(1, 0, 0.2), (1, 2, 0.2)], "gid long, severity int, confidence double")
    assert sorted(tuple(r) for r in catalogue.gathering_summary(src, found).collect()) == [(1, 2, 1, 1, 1), (2, 1, 1, 0, 0)]


def test_groups_of_sources(spark):
    df = spark.createDataFrame
    nodes = df([(1, 5, 3, [1, 2]), (1, 6, 3, [3]), (1, 7, 1, [1, 2, 3])], "gid long, person long, step int, texts array<long>")
    assert sorted(tuple(r) for r in graph.by_companion(nodes).collect()) == [(1, 1, 5, False), (1, 2, 5, False), (1, 3, 6, True)]
    edges = df([(1, 1, [1]), (1, 1, [2]), (1, 2, [1]), (2, 1, [1])], "gid long, step int, texts array<long>")
    assert [r.varies for r in graph.mark_variants(edges, df([(1, 1)], "gid long, text_id long")).orderBy("gid", "step", "texts").collect()] == [True, False, False, False]
    got = graph.gathered(df([(1,)], "id long"), df([(1, 4), (1, 1), (1, 3)], "of long, id long"), 2)
    assert sorted(r.text_id for r in got.collect()) == [1, 3]
    chains = df([(1, 1, 1), (1, 2, 1)], "gid long, text_id long, step int")
    assert [r.text_id for r in rules.on_routes(chains, df([(1, 2, True), (1, 1, False)], "gid long, text_id long, is_witness boolean")).collect()] == [1]


def test_report_is_all_rules_over_routes(spark):
    from corpusloom.functions.text import LATIN

    df = spark.createDataFrame
    chains = df([(1, t, "b", k, 10 * t + k, 10 * t + k + 1, "from", t != 2) for t in (1, 2, 3) for k in (1, 2)], "gid long, text_id long, book string, step int, student long, sheikh long, term string, raised boolean")
    people = df([(i, 1 + i % 12, "3", 4 if i % 2 else None, i % 3 == 0, 3, False) for i in range(10, 40)], "id long, rank int, generation string, tadlis_tier int, mixed_up boolean, severity int, none_after boolean")
    relations, hearings = df([(99, 11)], "teacher long, student long"), df([(12, 11, 2)], "sheikh long, student long, timing int")
    seen = df([(1, 3, True), (1, 1, False)], "gid long, text_id long, is_witness boolean")
    got = rules.report(chains, people, relations, hearings, seen, ("t",), LATIN).collect()
    own = chains.where("text_id <> 3")
    want = [rules.masking(own, people, ("t",), LATIN), rules.mixing_up(own, people, hearings, ("t",)), rules.hidden_break(own, people, relations, LATIN), rules.raised_stopped(own, people), rules.joined_cut(own, people)]
    assert sorted((r.type, r.people) for r in got) == sorted((r.type, r.people) for w in want for r in w.collect()) and got
    assert [(r.severity, r.confidence) for r in got] == sorted(((r.severity, r.confidence) for r in got), reverse=True)


def test_findings_of_low_confidence_stay_on_edges(spark, tmp_path):
    """26 and 13 have no rank, so their unrecorded link is of the least severity and confidence."""
    orders = {1: ([13, 1, 13], "RRN"), 2: ([2, 1], "RN"), 3: ([26, 1], "RN"), 4: ([8, 1], "RN"), 60: ([1, 26, 13], "NNN"), 61: ([13, 1, 2], "NNN"), 62: ([1, 8, 13], "NAN")}
    tables = {
        "region": ([(0, "r")], "r_regionkey int, r_name string"), "nation": ([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"), "customer": ([(1, "MACHINERY")], "c_custkey long, c_mktsegment string"),
        "supplier": ([(i, f"s{i}", 0) for i in (1, 2, 8, 13, 26)], "s_suppkey long, s_name string, s_nationkey int"), "orders": ([(o, 1) for o in orders], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, n + 1, 1, s, 1.0, flags[n]) for o, (people, flags) in orders.items() for n, s in enumerate(people)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = catalog.queries()["edge_decorations"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(2, "26", "13", "hidden_break", 0, 0.2), (2, "1", "2", "hidden_break", 0, 0.45), (2, "8", "13", "masking", 2, 0.75)} and got.count() == 3
