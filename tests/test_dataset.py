"""The dataset's folder end to end, results kept by their inputs, tables moved aside, order of gain, votes of pages."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from corpusloom.operators import gain, linking
from corpusloom.sources import cache, dataset, sinks


def put(root, path, value):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def folder(root):
    """Three people; a book of four records (prose, an undecided name, one without parts, one without a chain)."""
    person = lambda i, name, **more: {"id": i, "name": name, "header": f"{name}، أبو {i}. ثقة", "source": "x", "verdict": " ", "rank": 0, "tabaqa": "", "shuyukh": [], "talamidh": [], "quotes": []} | more
    put(root, "registry.json", [person("a", "زيد", talamidh=["b", "zz"]), person("b", "عمر", shuyukh=["a"], rank=3, verdict="ثقة"), person("c", "سعد", shuyukh=["b", "c"])])
    name = lambda i, *verbs: {"n": i or "?", "id": i, "how": None, "verbs": [*verbs]}
    put(root, "chains/one.json", {"book": "one", "compiler": "c", "chains": [
        {"id": 2, "number": 2, "names": [name("b", "حدثنا"), name(None), name("a", "عن")], "branches": []},
        {"id": 3, "number": 3, "names": [], "branches": [[name("b", "حدثنا", "قال"), name("a", "عن"), name("gone")], [name("b", "سمعت")]]},
    ]})
    put(root, "chains/_empty.json", "")
    record = lambda i, **more: {"id": i, "number": i, "kind": "hadith", "bab": f"bab{i}", "vol": "1", "arabic": f"text {i}", "parts": [{"type": "matn", "start": 0, "end": 4}]} | more
    put(root, "one/book.json", {"slug": "one", "title": "Book One"})
    put(root, "one/index.json", [{"file": "9.json", "name_ar": "nine"}, {"file": "10.json", "name_ar": " "}])
    put(root, "one/9.json", [record(1, kind="text"), record(2)])
    put(root, "one/10.json", [record(3, parts=None), record(4)])
    put(root, "one/11.json", '[{"id": 5, "arabic": ')
    put(root, "one/notes.json", [record(99)])
    put(root, "narrators.json", [{"id": 7, "death": 150, "fields": {"k": "exact"}, "quotes": []}, {"id": 8, "death": None, "fields": {"k": "probable"}, "quotes": []}])
    put(root, "s1_registry_map.json", {"7": {"registry": "a", "confidence": "exact"}, "8": {"registry": "b", "confidence": "probable"}})
    hearing = lambda i, timing, *claims: {"id": i, "timing": timing, "claims": [{"timing": t, "quote": q, "book": b} for t, q, b in claims]}
    put(root, "ilal.json", {"mudallisin": [{"id": "b", "tier": 4}, {"id": "b", "tier": 3}, {"id": None, "tier": 1}], "mukhtalitun": [
        {"id": "a", "ikhtilat": [{"text": "late"}, {"text": ""}, {"text": "late"}, {"text": "old"}], "severity": [{"value": "light"}, {"value": "harmful"}, {"value": "odd"}], "no_one_after": [{"any": 1}, 2],
         "group_rules": [{"group": "Basra", "timing": "after", "quote": "said", "book": 3}, {"group": "", "timing": None, "quote": "q", "book": 0}],
         "hearings": [hearing("b", "after", ("before", "q1", 1), ("after", "q2", 2)), hearing("a", "before"), hearing("zz", "both"), hearing("b", "before")]},
        {"id": "c", "ikhtilat": [], "severity": [], "no_one_after": [], "group_rules": [], "hearings": []},
    ]})
    return str(root)


def test_folder_end_to_end(spark, tmp_path):
    t = {n: df.collect() for n, df in dataset.load(spark, folder(tmp_path)).items()}
    ids = {r.name: r.id for r in t["people"]}
    a, b, c = ids["زيد"], ids["عمر"], ids["سعد"]
    assert len(ids) == 3 and {(r.teacher, r.student) for r in t["relations"]} == {(a, b), (b, c)}
    assert [(r.matn, r.book, r.chapter, r.file_no, r.place) for r in sorted(t["texts"], key=lambda r: (r.file_no, r.place))] == [("text 2", "Book One", "nine", 9, 1), ("text 3", "Book One", "bab3", 10, 0), ("text 4", "Book One", "bab4", 10, 1)]
    text = {r.matn: r.id for r in t["texts"]}
    got = {(r.text_id, r.step, r.student, r.sheikh, r.term) for r in t["links"]}
    assert got == {(text["text 2"], 1, c, b, None), (text["text 3"], 1, c, b, None), (text["text 3"], 2, b, a, "حدثنا")}
    assert [(r.slug, r.file_no) for r in t["bad"]] == [("one", 11)]
    assert [(r.sheikh, r.student, r.timing, r.evidence, r.book) for r in t["hearings"]] == [(a, b, 2, "q2", "2")]
    assert [(r.sheikh, r.group, r.timing, r.quote, r.book) for r in t["rules"]] == [(a, "Basra", 2, "said", 3)]
    flags = {r.id: (r.masks, r.tadlis_tier, r.mixed_up, r.severity, r.none_after, r.note) for r in t["people"]}
    assert flags == {a: (False, None, True, 3, True, "late — old"), b: (True, 3, False, None, False, None), c: (False, None, True, 2, False, "")}


def test_records_follow_numbers(spark, tmp_path):
    rows = dataset.records(spark, folder(tmp_path)).where("bad IS NULL").orderBy("file_no", "place").collect()
    assert [(r.file_no, r.place, r.id) for r in rows] == [(9, 0, 1), (9, 1, 2), (10, 0, 3), (10, 1, 4)]
    assert dataset.mapped(spark, str(tmp_path), ("exact", "probable")).count() == 2


def test_results_are_kept_by_their_inputs(spark, tmp_path):
    root, runs = f"file://{tmp_path}", []
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, None, "b")], "id int, x string, y string")

    def compute():
        runs.append(1)
        return df.groupBy("id").count()

    ask = lambda d, **p: sorted(map(tuple, cache.cached(spark, root, "t", {"d": d}, compute, p).collect()))
    assert ask(df, k=1) == ask(df.repartition(3), k=1) == [(1, 1), (2, 2)] and len(runs) == 1
    ask(df, k=2)
    ask(df.union(df.limit(1)), k=1)
    ask(df.withColumnRenamed("x", "z"), k=1)
    ask(df.select("id", F.col("y").alias("x"), F.col("x").alias("y")), k=1)
    assert len(runs) == 5
    keep = cache.key("t", {"d": df}, {"k": 1})
    assert cache.pruned(spark, root, "t", keep) == 4 and ask(df, k=1) and len(runs) == 5


def test_two_writers_of_one_result(spark, tmp_path):
    df = spark.range(100)
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: cache.cached(spark, f"file://{tmp_path}", "t", {"d": df}, lambda: df.selectExpr("id * 2 AS x")).count(), range(4)))
    assert got == [100] * 4 and len([p for p in tmp_path.iterdir() if not p.name.startswith(".")]) == 1


def test_tables_moved_aside_come_back(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert sinks.write_all({"t": spark.range(3)}, root) == {"t": 3} and sinks.write_all({"t": spark.range(5)}, root) == {"t": 5}
    assert spark.read.parquet(f"{root}/t").count() == 5 and not (tmp_path / "t._old").exists()
    (tmp_path / "t").rename(tmp_path / "t._old")  # as a stop between the two moves leaves it
    assert sinks.restored(spark, root, ["t", "none"]) == ["t"] and spark.read.parquet(f"{root}/t").count() == 5


def plain_greedy(hits, first):
    own = {}
    for b, name, _ in hits:
        own.setdefault(b, set()).add(name)
    n = {name: k for _, name, k in hits}
    had, out, total = set(own.pop(first, ())), [], 0
    while own:
        best = min(own, key=lambda b: (-sum(n[x] for x in own[b] - had), b))
        add = sum(n[x] for x in own[best] - had)
        if not add:
            break
        had |= own.pop(best)
        total += add
        out.append((len(out) + 1, best, add, total))
    return out


def test_order_of_gain_equals_plain_greedy(spark):
    rnd = random.Random(5)
    for books, names, first, fresh in ((1, 3, None, 16), (12, 40, None, 2), (12, 40, "b3", 16), (30, 60, None, 4)):
        n = {f"n{k}": rnd.randint(1, 4) for k in range(names)}
        hits = sorted({(f"b{rnd.randrange(books)}", x, n[x]) for x in rnd.choices(list(n), k=names * 4)})
        got = gain.order_of_gain(spark.createDataFrame(hits + hits[:3], "book string, name string, n long"), first, fresh)
        assert [tuple(r) for r in got.orderBy("place").collect()] == plain_greedy(hits, first)
    assert gain.order_of_gain(spark.createDataFrame([(None, "x", 1), ("b", "y", 0)], "book string, name string, n long")).count() == 0


def test_votes_of_pages_against_brute_force(spark):
    rnd = random.Random(6)
    entries = [(b, e, page) for b in "xy" for e, page in enumerate(sorted(rnd.choices(range(3, 40), k=25)))]
    index = [(b, v, p, 20 * v + p) for b in "xy" for v in (0, 1) for p in range(20)]
    cites = [(i, rnd.choice("xyz"), rnd.choice([0, 1, 2]), rnd.randrange(22)) for i in range(120) for _ in range(rnd.randint(0, 6))]
    want = set()
    for i in range(120):
        pages = [(b, 20 * v + p) for k, b, v, p in cites if k == i and b in "xy" and v < 2 and p < 20]
        votes = {}
        for b, p in pages:
            on = {e for bb, e, s in entries if bb == b and s == p} | {e for bb, e, s in [max((x for x in entries if x[0] == b and x[2] < p), key=lambda x: (x[2], x[1]), default=(None, None, None))] if e is not None}
            for e in on:
                votes[e] = votes.get(e, 0) + 1
        want |= {(i, e, n, len(pages)) for e, n in votes.items()}
    got = linking.page_votes(*[spark.createDataFrame(x, s) for x, s in ((cites, "left_id int, book string, vol int, printed int"), (index, "book string, vol int, printed int, page int"), (entries, "book string, entry int, page int"))])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 80


def test_duplicates_are_no_rivals(spark):
    kind = "left_id int, right_id int, name_score double, votes int, pages int, nisba boolean, kunya boolean, death_a int, death_b int, rank_a int, rank_b int, verdict_a string, verdict_b string, main boolean, lineage array<string>"
    row = lambda left, right, score, main, line, death=None: (left, right, score, 3, 3, None, None, 50, death, None, None, None, None, main, line)
    rows = [row(1, 1, 5.0, True, ["a", "b"]), row(1, 2, 4.9, False, ["a", "b"]), row(1, 3, 1.0, False, ["c"]), row(2, 1, 5.0, True, ["a"], 50), row(2, 2, 4.9, False, ["a"], 80), row(3, 1, 5.0, False, ["a"]), row(3, 2, 4.9, False, ["a"])]
    got = {r.left_id: (r.right_id, r.margin, r.duplicates, r.confidence) for r in linking.best_by_evidence(spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == (1, 4.0, [2], "exact") and got[2][2] == [] and got[3] == (1, 0.1, [], "none")
    assert "duplicates" not in linking.best_by_evidence(spark.createDataFrame(rows, kind).drop("main", "lineage")).columns
