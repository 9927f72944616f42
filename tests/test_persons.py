"""Merging of one person's entries and candidates for names, against slow straight versions."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpusloom.operators import candidates as cand
from corpusloom.operators import merging

ENTRY = "id bigint, fallback boolean, units array<string>, tail array<string>, nisbas array<string>, by_names array<string>, death string, sources array<string>, listed int, points boolean, fathers array<string>"


def brute_merge(rows, primary="primary"):
    """One entry after the other, one block after the other, as the rule is told."""
    e = {r[0]: dict(zip("id fallback units tail nisbas by_names death sources listed points fathers".split(), r)) for r in rows}
    for x in e.values():
        for k in ("units", "tail", "nisbas", "by_names", "fathers"):
            x[k] = x[k] or []
        x["sources"], x["death"] = x["sources"] or [primary], (x["death"] or "").strip()
        x["listed"], x["fallback"], x["points"] = x["listed"] or 0, bool(x["fallback"]), bool(x["points"])
    bearers = Counter(n for x in e.values() for n in set(x["nisbas"]))

    def clash(a, b):
        great = len(a["units"]) > 3 and len(b["units"]) > 3 and a["units"][3] != b["units"][3]
        apart = any(a[k] and b[k] and not set(a[k]) & set(b[k]) for k in ("nisbas", "by_names"))
        return bool(great or apart or (a["death"] and b["death"] and a["death"] != b["death"]))

    groups = defaultdict(list)
    for i in sorted(e):
        u = e[i]["units"]
        if len(u) >= 3:
            groups[3, e[i]["fallback"], *u[:3]].append(i)
        if len(u) == 2:
            for n in sorted(set(e[i]["nisbas"])):
                groups[2, e[i]["fallback"], *u, n].append(i)
    to = {i: i for i in e}
    for key, ids in groups.items():
        m = [e[i] for i in ids]
        books = [s for x in m for s in set(x["sources"])]
        if len(ids) < 2 or any(to[i] != i for i in ids) or len(books) != len(set(books)):
            continue
        if any(clash(a, b) for a in m for b in m if a["id"] < b["id"]):
            continue
        head, good = m[0], True
        for x in m[1:]:
            mark = bool(set(head["nisbas"]) & set(x["nisbas"]) or set(head["by_names"]) & set(x["by_names"]))
            if key[0] == 2:
                good &= set(head["tail"]) == set(x["tail"]) or any(bearers[n] <= 4 for n in set(head["nisbas"]) & set(x["nisbas"]))
            elif primary in books:
                good &= mark
            else:
                s, l = (x, head) if len(head["units"]) > len(x["units"]) else (head, x)
                good &= mark or head["units"] == x["units"] or (l["units"][: len(s["units"])] == s["units"] and not s["tail"])
        if good:
            root = min(m, key=lambda x: (primary not in x["sources"], -x["listed"], x["id"]))["id"]
            for i in ids:
                to[i] = root
    heads = defaultdict(list)
    for i in sorted(e):
        if not e[i]["fallback"] and len(e[i]["units"]) >= 2:
            heads[tuple(e[i]["units"][:2])].append(i)
    gone = {i for i in to if to[i] != i}
    for ids in heads.values():
        if len(ids) != 2 or set(ids) & gone:
            continue
        a, b = (e[i] for i in ids)
        if min(len(a["units"]), len(b["units"])) > 2 or primary in a["sources"] + b["sources"] or a["points"] or b["points"] or clash(a, b) or any(x != y for x, y in zip(a["fathers"], b["fathers"])):
            continue
        root = b["id"] if b["listed"] > a["listed"] else a["id"]
        to[a["id"]] = to[b["id"]] = root

    def top(i):
        return i if to[i] == i else top(to[i])

    return {(i, top(i)) for i in to if to[i] != i}


def random_entries(seed, n):
    rnd = random.Random(seed)
    pick = lambda k, words: [rnd.choice(words) for _ in range(rnd.randint(0, k))]
    rows = []
    for i in range(n):
        units = [rnd.choice("ab"), f"u{rnd.randrange(n // 4)}", *pick(2, "xy")][: rnd.randint(1, 4)]
        tail = pick(1, ["t", "v"])
        sources = rnd.sample(["primary", "s1", "s2", "s3", "s4"], rnd.choice([0, 1, 1, 1, 2]))
        rows.append((i * 3, rnd.random() < 0.1, units, tail, list(dict.fromkeys(pick(2, ["n1", "n2", "n3"] + [f"m{k}" for k in range(3)]))), pick(1, ["k1", "k2"]), rnd.choice([None, None, "", "100", "101"]), sources, rnd.randint(0, 3), rnd.random() < 0.05, units[1:3]))
    return rows


def test_same_person_against_brute_force(spark):
    merged = 0
    for seed, n in ((1, 60), (2, 150), (3, 900)):
        rows = random_entries(seed, n) + [(10**6, None, None, None, None, None, None, None, None, None, None), (10**6 + 1, False, ["q", "r", "s"], [], [], [], None, ["s1"], 1, False, []), (10**6 + 2, False, ["q", "r", "s"], [], [], [], None, ["s2"], 2, False, [])]
        got = {tuple(r) for r in merging.same_person(spark.createDataFrame(rows, ENTRY)).collect()}
        assert got == brute_merge(rows)
        assert (10**6 + 1, 10**6 + 2) in got
        merged += len(got)
    assert merged > 20
    assert merging.same_person(spark.createDataFrame([], ENTRY)).count() == 0


def test_blocks_in_turn(spark):
    """Two blocks of two names that share a member: the earlier one takes it, the later one falls."""
    two = lambda i, nisbas, source, listed: (i, False, ["a", "b"], [], nisbas, [], None, [source], listed, False, [])
    rows = [two(1, ["n"], "s1", 1), two(2, ["n", "o"], "s2", 2), two(3, ["o"], "s3", 3), two(4, ["z"], "s4", 0)]
    got = {tuple(r) for r in merging.same_person(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == brute_merge(rows)
    rows[1] = two(2, ["n", "o"], "s2", 0)
    got = {tuple(r) for r in merging.same_person(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == brute_merge(rows) == {(2, 1)}


def test_hot_block_makes_no_pairs(spark):
    rows = [(i, False, ["a", "b", "c"], [], [], [], None, [f"s{i % 5}"], 0, False, []) for i in range(3000)]
    e = merging.prepared(spark.createDataFrame(rows, ENTRY))
    assert merging.blocks(e).count() == 0


def test_merged_lists_and_facts(spark):
    merged = spark.createDataFrame([(2, 1), (3, 1)], "id bigint, root bigint")
    lists = spark.createDataFrame([(1, "teachers", 1, "a"), (1, "teachers", 2, "a"), (2, "teachers", 1, "b"), (2, "teachers", 2, "a"), (3, "teachers", 1, "b"), (3, "students", 1, "c"), (4, "teachers", 1, "a")], "id bigint, side string, pos int, name string")
    got = sorted((r.id, r.side, r.place, r.name) for r in merging.merged_lists(lists, merged).collect())
    assert got == [(1, "students", 1, "c"), (1, "teachers", 1, "a"), (1, "teachers", 2, "a"), (1, "teachers", 3, "b"), (4, "teachers", 1, "a")]
    facts = spark.createDataFrame([(1, "h1", ["x"], None, ["s1"]), (2, "h2", ["x", "y"], "good", ["s2"]), (3, "h3", None, "weak", ["s1", "s3"]), (4, "h4", None, None, None)], "id bigint, header string, aliases array<string>, verdict string, sources array<string>")
    got = sorted(tuple(r) for r in merging.merged_facts(facts, merged).collect())
    assert got == [(1, ["x", "h2", "y", "h3"], "good", ["s1", "s2", "s3"], [2, 3]), (4, [], None, [], [])]


PERSON = "id bigint, fallback boolean, first string, units array<string>, other_units array<string>, own array<string>, words array<string>, by_names array<string>, titles array<string>, by_headed boolean, aliases array<array<string>>, refs array<array<string>>, fame int"
NAME = "name_id bigint, words array<string>, chain array<string>, son boolean, by_son boolean, article boolean"


def brute_candidates(name, people, about="ابو"):
    """The tiers one after the other, for one name."""
    _, w, chain, son, by_son, article = name
    if not w:
        return set()
    starts = lambda a, b: bool(a) and bool(b) and a[: len(b)] == b[: len(a)]

    def among(ps, firsts):
        p = {x[0]: x for x in ps}
        fits = lambda x: len(chain) < 2 or starts(x[3], chain) or starts(x[4] or [], chain)
        alias = {i for i, x in p.items() if w in x[10] and len(w) >= 3}
        refs = {i for i, x in p.items() if w in x[11]}
        if alias:
            return alias
        if son and len(w) <= 3:
            found = {i for i, x in p.items() if any(x[3][k : k + len(w)] == w for k in range(1, 5))}
            own = {i for i in found if p[i][3][1 : 1 + len(w)] == w}
            if own and max(p[i][12] for i in own) >= max(p[i][12] for i in found):
                found = own
            return found | refs
        found = set()
        if w[0] not in cand.NOBODY:
            whole = [x for x in ps if set(w) <= set(x[6])]
            ok = [x for x in whole if x[2] is not None and ((w[0] == x[2] and w[0] != about) or (w[0] == about and len(w) > 1 and w[1] in x[7])) and fits(x)]
            if w[0] == about and len(w) > 2:
                better = [x for x in ok if ((x[3][1:2] == w[2:3] or x[5][:3] == w[:3]) if by_son else w[2] == x[2])]
                ok = better or ok
            found = {x[0] for x in ok}
            grand = False
            if not found and whole:
                grand = len(w) >= 2
            elif not whole and w[0] == about and len(w) >= 3:
                pool = [x for x in ps if w[1] in x[7]]
                rest = w[2:]
                anc = rest[:2] if rest[0] == about else rest[:1]
                found = {x[0] for x in pool if (any(x[3][k : k + len(anc)] == anc for k in range(1, 5)) if by_son else set(rest) <= set(x[5]) | set(x[6]) and fits(x))}
            elif not whole and len(w) >= 2:
                base = [x for x in ps if (x[6][:2] == w[:2] or (x[4] or [])[:2] == w[:2]) and fits(x)]
                n = [len(set(w) & set(x[6])) for x in base]
                found = {x[0] for x, k in zip(base, n) if k == max(n)}
                grand = not found
            if grand and w[0] != about:
                for x in ps:
                    seq = [v for k, v in enumerate(x[5]) if not (k and x[5][k - 1] == about and v in x[7] and v not in x[3])][1:]
                    it = iter(seq)
                    place = x[3].index(w[1]) if w[1] in x[3] else 0
                    if x[2] == w[0] and not x[9] and place <= 2 and all(v in it for v in w[1:]):
                        found.add(x[0])
        if found:
            return found
        if refs:
            return refs
        if len(w) == 1 and article:
            return {i for i, x in p.items() if w[0] in x[5] or w[0] in x[8]}
        if len(w) == 1 and w[0] not in firsts:
            return {i for i, x in p.items() if w[0] in x[8] and w[0] not in x[3]}
        return set()

    for kind in (False, True):
        ps = [x for x in people if x[1] == kind]
        found = among(ps, {x[2] for x in people if kind or not x[1]}) | {x[0] for x in ps if w in x[10] and len(w) < 3}
        if found:
            return found
    return set()


def test_candidates_against_brute_force(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["a", "b", "c", "d", "e"])
    people = []
    for i in range(160):
        units = [word() for _ in range(rnd.randint(0, 4))]
        by = [word()] if rnd.random() < 0.5 else []
        own = [*units, *(["ابو", by[0]] if by else []), *[rnd.choice(["n1", "n2", "n3"]) for _ in range(rnd.randint(0, 1))]]
        headed = bool(by) and rnd.random() < 0.2
        own = ["ابو", *by, *units] if headed else own
        other = [word() for _ in range(3)] if rnd.random() < 0.1 else None
        aliases = [[word() for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(0, 1))]
        refs = [[word(), rnd.choice(["n1", "r"])] for _ in range(rnd.randint(0, 1))]
        titles = [rnd.choice(["t1", "t2", "n3", "q1"])] if rnd.random() < 0.2 else []
        people.append((i, rnd.random() < 0.25, own[0] if own else None, units, other, own, own + [rnd.choice(["z1", "z2"])], by, titles, headed, aliases, refs, rnd.randint(0, 9)))
    names = [(900, [], [], False, False, False)]
    for i in range(500):
        w = [word() for _ in range(rnd.randint(1, 4))]
        kind = rnd.random()
        if kind < 0.25:
            w = ["ابو", *w]
        elif kind < 0.35:
            w = [rnd.choice(["n1", "n2", "n3", "t1", "t2", "q1", "r", "شيخ"])]
        elif kind < 0.5:
            x = rnd.choice(people)
            w = (x[5][:2] + x[5][-1:]) or w
        elif kind < 0.6:
            w = next((x[11][0] for x in rnd.sample(people, 40) if x[11]), w)
        chain = w[: rnd.randint(0, 3)] if w[0] != "ابو" else w[2:4]
        names.append((i, w, chain, rnd.random() < 0.15, w[0] == "ابو" and rnd.random() < 0.5, len(w) == 1 and rnd.random() < 0.8))
    df, ps = spark.createDataFrame(names, NAME), spark.createDataFrame(people, PERSON)
    found = cand.candidates(df, ps)
    rows = found.collect()
    got = defaultdict(set)
    for r in rows:
        got[r.name_id].add(r.id)
    for n in names:
        assert got.get(n[0], set()) == brute_candidates(n, people), n
    assert {r.tier for r in rows} == set(cand.TIERS)
    assert sum(r.candidates for r in cand.tier_counts(found).collect()) == len(rows)
    assert cand.candidates(df.limit(0), ps).count() == 0 and cand.candidates(df, ps.limit(0)).count() == 0


def test_runs_and_rarest_words(spark):
    """What names are looked up by: runs in a lineage, and the two words that the fewest entries have."""
    c = spark.range(1).select(cand._runs(F.array(*map(F.lit, "abcd")), range(1, 3), 2).alias("r")).first().r
    assert sorted(c) == [["b"], ["b", "c"], ["c"], ["c", "d"]]
    each = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "x")], "name_id int, w string")
    index = spark.createDataFrame([(k, "x") for k in range(5)] + [(1, "z")], "id int, w string")
    assert {r.name_id: r.ws for r in cand._rarest(each, index, 2).collect()} == {1: ["y", "z"], 2: ["x"]}
