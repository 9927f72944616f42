"""Alignment of two books in order, against plain programs on small books."""

import random

from corpusloom.operators import ordered

ENTRY = "gid bigint, pos bigint, words array<string>, symbols array<string>"


def longest(values):
    """Length of a longest rising run, by the quadratic definition."""
    best = []
    for i, v in enumerate(values):
        best.append(1 + max([best[j] for j in range(i) if values[j] < v], default=0))
    return max(best, default=0)


def test_longest_rise():
    rnd = random.Random(1)
    for n in (0, 1, 5, 40):
        for _ in range(30):
            v = rnd.sample(range(n * 2), n)
            run = [v[k] for k in ordered.longest_rise(v)]
            assert run == sorted(set(run)) and len(run) == longest(v)


def likeness(a, b):
    (wa, sa), (wb, sb) = a, b
    if not wa or not wb or wa[0] != wb[0]:
        return 0.0
    n = 0
    while n < min(len(wa), len(wb)) and wa[n] == wb[n]:
        n += 1
    return n / max(len(wa), len(wb)) + (0.5 * len({*sa} & {*sb}) / len({*sa} | {*sb}) if sa and sb else 0)


def brute(left, right):
    """One walk over both whole books."""
    key = lambda e: (tuple(e[0][:3]), frozenset(e[1])) if len(e[0]) >= 2 else None
    ka, kb = [key(e) for e in left], [key(e) for e in right]
    both = [(i, kb.index(k)) for i, k in enumerate(ka) if k and ka.count(k) == 1 and kb.count(k) == 1]
    kept = [both[k] for k in ordered.longest_rise([k for _, k in both])]
    out = [(i, k, 2.0) for i, k in kept]
    for (i0, k0), (i1, k1) in zip([(-1, -1), *kept], [*kept, (len(left), len(right))]):
        j = k0 + 1
        for i in range(i0 + 1, i1):
            best = max(((round(likeness(left[i], right[k]) - 0.002 * (k - j), 12), -k) for k in range(j, k1)), default=(0, 0))
            if best[0] >= 0.5:
                out.append((i, -best[1], best[0]))
                j = 1 - best[1]
    return sorted(out)


def book(rnd, n, base=None):
    word = lambda: rnd.choice("abcde")
    rows = [([word() for _ in range(rnd.randint(0, 5))], [rnd.choice("xyz") for _ in range(rnd.randint(0, 3))]) for _ in range(n)]
    return rows if base is None else [rnd.choice([r, b]) if rnd.random() < 0.6 else b for r, b in zip(rows, base)][rnd.randint(0, 2) :]


def test_align_books_against_one_walk(spark):
    rnd = random.Random(2)
    books = {}
    for g, n in enumerate((0, 1, 12, 60, 150, 300)):
        base = book(rnd, n)
        books[g] = (base, book(rnd, n, base))
    books[90] = ([], book(rnd, 5))
    books[91] = ([(["a"], [])] * 30, [(["b"], [])] * 700 + [(["a"], [])])
    rows = [[(g, p, *e) for g, b in books.items() for p, e in enumerate(b[side])] for side in (0, 1)]
    left, right = (spark.createDataFrame(r, ENTRY) for r in rows)
    got = {}
    for r in ordered.align_books(left, right).collect():
        got.setdefault(r.gid, []).append((r.i, r.k, round(r.score, 12)))
    for g, (a, b) in books.items():
        assert sorted(got.get(g, [])) == brute(a, b), g
    assert sum(map(len, got.values())) > 200 and any(s < 2 for x in got.values() for *_, s in x)
    assert ordered.align_books(left.limit(0), right.limit(0)).count() == 0


def test_nulls_have_no_partner(spark):
    left = spark.createDataFrame([(1, 0, None, None), (1, 1, ["a", "b"], None)], ENTRY)
    assert [tuple(r) for r in ordered.align_books(left, left).collect()] == [(1, 1, 1, 2.0)]
