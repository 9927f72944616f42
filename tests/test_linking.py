"""Linking on rows made by hand and against slow straight versions: ties, nulls, empty tables."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import linking


def alike(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    s, l = sorted((a, b), key=len)
    if len(a) == len(b):
        s, l = a, b
    at = [i for i in range(len(l) - len(s) + 1) if l[i : i + len(s)] == s]
    if at and (len(s) > 1 or (s[0] not in linking.LIGHT and at[0] in (0, len(l) - 1))):
        return 0.5 + 0.4 * len(s) / len(l)
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_spans_against_brute_force(spark):
    random.seed(5)
    word = lambda: random.choice(["zayd", "umar", "ali", "بن", "ابو"])
    name = lambda: [word() for _ in range(random.randint(0, 4))]
    names = {t: [name() for _ in range(random.randint(1, 6))] for t in range(60)}
    spans = {t: [name() for _ in range(random.randint(0, 12))] for t in range(60)}
    want = set()
    for t, ns in names.items():
        cur = 0
        for pos, n in enumerate(ns):
            near = [(round(alike(n, s), 9), -i, 10 * (cur + i)) for i, s in enumerate(spans[t][cur : cur + 6]) if round(alike(n, s), 9) >= 0.6]
            best = max(near, default=None)
            want.add((t, pos, best and best[2], best[0] if best else 0.0))
            cur += 1 - best[1] if best else 0
    n = spark.createDataFrame([(t, p, w) for t, ns in names.items() for p, w in enumerate(ns)], "text_id bigint, pos int, words array<string>")
    s = spark.createDataFrame([(t, 10 * p, w) for t, ns in spans.items() for p, w in enumerate(ns)], "text_id bigint, at int, words array<string>")
    assert {tuple(r) for r in linking.align_spans(n, s).collect()} == want
    assert linking.align_spans(n.where("false"), s).count() == 0


def test_cover_and_students(spark):
    s = "name_id bigint, id bigint, cover double, lineage boolean, main boolean, marked boolean, fame bigint"
    rows = [
        (1, 5, 0.7, None, None, None, None), (2, 5, 0.5, True, True, True, 9), (3, 5, 0.8, True, False, False, 1), (3, 6, 0.8, False, True, True, 50),
        (4, 5, 0.8, True, False, False, 1), (4, 6, 0.8, True, True, False, 1), (5, 5, 1.0, False, False, True, 1), (5, 6, 1.0, False, False, False, 9),
        (6, 5, 1.0, False, False, False, 9), (6, 6, 1.0, False, False, False, 3), (7, 5, 1.0, None, None, None, 8), (7, 6, 1.0, None, None, None, 3), (8, 5, 0.9, None, None, None, 1), (8, 6, 0.7, True, True, True, 9),
    ]
    got = {r.name_id: (r.id, r.how) for r in linking.link_by_cover(spark.createDataFrame(rows, s)).collect()}
    assert got == {1: (5, "unique"), 2: (None, "low_cover"), 3: (5, "nasab"), 4: (6, "main"), 5: (5, "marker"), 6: (5, "fame"), 7: (None, "ambiguous"), 8: (5, "cover")}
    items = spark.createDataFrame([(i,) for i in range(1, 9)], "item_id bigint")
    cands = [
        (1, 1, 5, True, 1), (1, 1, 6, False, 99), (2, 0, 5, True, 9), (2, 0, 6, True, 3), (3, 0, 5, True, 8), (3, 0, 6, True, 3), (4, 1, 5, None, None), (5, 0, 5, False, 9), (5, 0, 6, False, 1),
        (6, 1, 5, False, 9), (6, 1, 6, False, 1), (7, 0, 5, False, 4), (7, 1, 6, True, 9),
    ]
    got = {r.item_id: (r.id, r.how) for r in linking.link_students(items, spark.createDataFrame(cands, "item_id bigint, form int, id bigint, listed boolean, fame bigint")).collect()}
    assert got == {1: (5, "listed"), 2: (5, "listed_fame"), 3: (None, "ambiguous"), 4: (5, "unique_unlisted"), 5: (5, "fame_unlisted"), 6: (None, "unlisted"), 7: (5, "unique_unlisted"), 8: (None, "missing")}


def test_evidence(spark):
    s = "left_id bigint, right_id bigint, name_score double, votes int, pages int, nisba boolean, kunya boolean, death_a int, death_b int, rank_a int, rank_b int, verdict_a string, verdict_b string"
    rows = [
        (1, 5, 3.0, 3, 3, True, None, 99, 1, 4, 4, "sure", "sure enough"), (1, 6, 3.0, None, None, None, None, None, None, None, None, None, None),
        (2, 5, 4.0, 0, 0, False, False, 10, 50, 1, 3, "a", "b"), (3, 6, 3.0, 1, 2, None, None, None, None, None, None, None, None), (3, 5, 3.0, 1, 2, None, None, None, None, None, None, None, None),
    ]
    got = {r.left_id: (r.right_id, r.score, r.margin, r.confidence) for r in linking.best_by_evidence(spark.createDataFrame(rows, s)).collect()}
    assert got == {1: (5, 3.0 + 8 + 1.5 + 1 + 1.5 + 1.5, 13.5, "exact"), 2: (5, 4.0 - 1 - 1 - 3 - 1 - 0.7, 7.3, "none"), 3: (5, 6.0, 0.0, "none")}
    assert linking.best_by_evidence(spark.createDataFrame([], s)).count() == 0


def test_heads_join_tails(spark):
    p = spark.createDataFrame(
        [(1, 0, 0, 7, False), (1, 0, 1, None, False), (1, 1, 0, 3, True), (1, 1, 1, 8, True), (1, 1, 2, 9, True), (1, 2, 0, 8, False), (1, 3, 0, 1, True), (1, 3, 1, 8, True), (1, 3, 2, None, True), (2, 0, 0, 4, False)],
        "text_id bigint, part int, pos int, id bigint, complete boolean",
    )
    r = spark.createDataFrame([(8, 7), (8, 7), (9, 7)], "teacher bigint, student bigint")
    out = {}
    for x in sorted(tuple(x) for x in linking.join_heads(p, r).collect() if x.text_id == 2 or x.part in (0, 2)):
        out.setdefault(x[:2], []).append(x[3])
    assert out == {(1, 0): [7, 8, 9], (1, 2): [8, None], (2, 0): [4]}


def test_compilers(spark):
    names = ["البخاري", "الجماعة سوى ابن ماجه", "الأربعة", "الستة سوى مسلم وأبو داود", "الخمسة", "الخمسة سوى مسلم", "الجماعة سوى زيد", "زيد", None, ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = {r.i: tuple(r.k) for r in df.select("i", linking.compilers_named(F.col("n")).alias("k")).collect()}
    six = linking.SIX
    assert got == {0: ("bukhari",), 1: six[:5], 2: six[2:], 3: ("bukhari", "tirmidhi", "nasai", "ibnmajah"), 4: (), 5: ("bukhari", *six[2:]), 6: (), 7: (), 8: (), 9: ()}
    df = spark.createDataFrame([("دس", "nasai"), ("٤", "muslim"), ("٣ خ", "tirmidhi"), ("ع", "bukhari"), (None, "muslim"), ("م", "nobody")], "s string, k string")
    assert [r[0] for r in df.select(linking.carries_symbol(F.col("s"), F.col("k"))).collect()] == [True, False, True, True, False, False]
    df = spark.createDataFrame([(" zayd b. ali", "A"), ("umar", "A"), (None, "A"), ("zayd", None), ("zayd", "B")], "n string, b string")
    assert [r[0] for r in df.select(linking.compiles(F.col("n"), F.col("b"), {"A": "zayd"})).collect()] == [True, False, False, False, False]
    owner = linking.owner_of_book(F.col("b"), (("الطبراني", "t"),))
    df = spark.createDataFrame([("المعجم للطبراني",), ("كتاب",)], "b string")
    assert [r[0] for r in df.select(owner).collect()] == ["t", "كتاب"]


def test_coverage(spark):
    n = spark.createDataFrame([("a b", 3, ["a", "b"]), ("b a", 2, ["b", "a"]), ("c", 1, ["c"]), ("", 4, [])], "name string, n bigint, words array<string>")
    h = spark.createDataFrame([("x", ["a", "z", "b"]), ("x", ["a", "b"]), ("y", ["b", "q"]), ("y", []), ("z", ["a", "b"])], "book string, words array<string>")
    assert {tuple(r) for r in linking.book_coverage(n, h).collect()} == {("x", 1, 3), ("z", 1, 3), (None, 1, 3)}
    assert [tuple(r) for r in linking.book_coverage(n, h.where("false")).collect()] == [(None, 0, 0)]


def test_gold(spark):
    rows = spark.createDataFrame([("a", "m", 1, 1), ("a", "m", 1, 2), ("a", "k", None, 3), ("a", "k", 4, None)], "book string, method string, ours int, gold int")
    got = {(r.book, r.method): tuple(r)[2:] for r in linking.gold_report(rows).collect()}
    assert got[("a", "m")] == (2, 2, 1, 1, 0, 0.5) and got[("a", "k")] == (2, 1, 0, 0, 1, None) and got[(None, None)] == (4, 3, 1, 1, 1, 0.5)


def test_entries_go_on_from_cell_to_cell(spark):
    """An entry reaches over pages of cells in which none starts; cells change nothing."""
    entries = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 5), ("b", 9, 4)], "book string, entry int, page int")
    pages = spark.createDataFrame([("a", 0), ("a", 4), ("a", 5), ("a", 23), ("b", 3), ("b", 4), ("b", 11)], "book string, page int")
    want = [("a", 0, 1), ("a", 0, 2), ("a", 4, 2), ("a", 5, 2), ("a", 5, 3), ("a", 23, 3), ("b", 4, 9), ("b", 11, 9)]
    for cell in (1, 3, 4096):
        assert sorted(map(tuple, linking.entries_on_pages(entries, pages, cell).collect())) == want
