"""Operators 2, 3 and 4: edge cases and small brute force."""

import datetime as dt
import random
import re

from corpusloom.llm import mixing, quality, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """doc_id, text, lang, source, n_chars and columns whose names the operators might use themselves."""
    full = [(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _w string, k long")


def brute_quality(t):
    ws = WORD.findall(t or "")
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    cov = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cov)


def test_quality_measures(spark):
    random.seed(5)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "x " * 30, "é ñ\x0bü\x1cz", "l1\nl1\n\nl1 ", "# * $ %%"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(40)] + ["word " * 30000]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(0, texts[5], None), (None, "a b", None)]
    got = quality.verdicts(quality.ledger(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    short = {i: t for i, t in enumerate(texts[:-1])}
    for r in got:
        if r.doc_id in short and not (r.doc_id == 0 and r.n_words):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(short[r.doc_id]), short[r.doc_id]
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert {(r.version, r.rule, r.n_failed) for r in quality.ablation(quality.ledger(docs(spark, rows[:5]))).collect()} >= {("base", "few_words", 5)}
    assert quality.ledger(docs(spark, [])).count() == 0


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        level = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 3 * sizes[s]]
        if not over:
            target |= level
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    return target


def test_mixing(spark):
    random.seed(6)
    rows = [(i, "w " * random.randrange(0, 40), random.choice(["a", "b", "c", None, "", "d"][: 1 + i % 6])) for i in range(300)]
    rows += [(7, None, "a"), (None, "w w", "z"), (8, "w " * 5, "a")]
    got = mixing.curriculum(docs(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and len(r.positions) == r.passes <= 3 and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.curriculum(docs(spark, rows[::-1]).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.positions)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.curriculum(docs(spark, [])).count() == 0


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    by = {}
    for r in mixing.by_position(mixing.curriculum(docs(spark, rows))).collect():
        by.setdefault(r.source, []).extend(r.positions)
    early = {s: sum(p < 0.5 for p in ps) / len(ps) for s, ps in by.items()}
    assert early["a"] > 0.58 and abs(early["b"] - 0.5) < 0.05 and early["c"] < 0.42


def test_url_filter(spark):
    d = lambda m, x: dt.date(2024, m, x)
    cap = [(1, "http://a.Bad.com/x/y?q", d(3, 1)), (1, "http://a.Bad.com/x/y?q", d(3, 1)), (2, "https://u:p@a.bad.com:8/", d(6, 1)), (3, "http://notbad.com/", d(3, 1)), (4, None, d(3, 1)), (5, "junk", d(3, 1)), (6, "http://ok.org/dir/f", d(3, 1)), (7, "http://ok.org/dirt/f", d(3, 1)), (8, "http://bad.com", None), (9, "http://bad.com.", d(2, 1))]
    captures = spark.createDataFrame([(*r, "c") for r in cap], "page_id long, url string, fetched date, pattern string")
    ent = [("bad.com", "m", "add", d(2, 1)), ("bad.com", "m", "remove", d(5, 1)), ("ok.org/dir", None, "add", d(1, 1)), ("bad.com", "n", "add", d(2, 1)), ("bad.com", "n", "remove", d(2, 1)), (None, "m", "add", d(1, 1))]
    entries = spark.createDataFrame(ent, "pattern string, category string, action string, at date")
    got = sorted((r.page_id, r.n_entries, r.categories, r.blocked) for r in url_filters.url_filter(captures, entries).collect())
    assert got == [(1, 1, "m", True), (1, 1, "m", True), (2, 0, "", False), (3, 0, "", False), (4, 0, "", False), (5, 0, "", False), (6, 1, "", True), (7, 0, "", False), (8, 0, "", False), (9, 1, "m", True)]
    assert url_filters.url_filter(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filters.url_filter(captures.limit(0), entries).count() == 0
