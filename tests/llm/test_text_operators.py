"""Operators 1, 5, 6, 7, 8, 9 and 10 against brute force, with edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_native import WORD, docs

from corpusloom.llm import bpe, hashing, html, jaccard, media, suffix, token_shards, toxicity

EDGES = [None, "", " \n", "a", "A  b", "a b c d", "é" * 300, "x" * 2000, "  leading", "日本語 テキスト ½", "<|endoftext|> it's", "the the the the the the", "q" * 399, "ab" * 300]
BIG = 2**60 + 1


def rows_of(extra=()):
    base = [(i, t, "s") for i, t in enumerate(EDGES)]
    return [*base, (3, "a", "s"), (None, "a", "s"), (None, None, "s"), (BIG, "big", "s"), *[(1000 + i, t, "s") for i, t in enumerate(extra)]]


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def test_word_hashes():
    random.seed(1)
    texts = [" ".join(random.choice(["a", "bb", "é", "long" * 9]) for _ in range(random.randrange(9))).encode() for _ in range(200)]
    seen, n = {}, 0
    for first, h, at in hashing.word_hashes(texts):
        for k in range(len(at) - 1):
            ws = texts[first + k].split()
            assert at[k + 1] - at[k] == len(ws)
            for w, x in zip(ws, h[at[k] : at[k + 1]]):
                assert seen.setdefault(w, int(x)) == int(x)
                n += 1
    assert len(set(seen.values())) == len(seen) and n
    long = b"word " * 500_000 + b"end"
    (_, h, at), = hashing.word_hashes([long])
    assert len(h) == 500_001 and len(set(h.tolist())) == 2


def test_media(spark):
    rows = rows_of()
    got = media.media_columns(docs(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(map(key, [tuple(r)[:5] for r in got])) == sorted(map(key, want))
    assert len({r.feature for r in got if r.n_bytes == 0}) == 1
    index, folder = media.store(docs(spark, rows))
    meta = media.metadata(index, folder).collect()
    assert all(m.width == 576 and m.bits == 8 for m in meta) and len(meta) == len(rows)
    shard = index.first().shard
    names = media.listing(folder, shard)
    assert names and all(n.endswith(".png") for n, _ in names) and len({n for n, _ in names}) == len(names)
    assert media.media_columns(docs(spark, [])).count() == 0


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="with-sidebar"><header><p>Site name</p></header>
    <nav><ul><li><a href=/a>one</a></li></ul></nav><!-- no --><div class="ad">Buy the thing of the day and be glad.</div><article><h1>Head &amp; line</h1><p>The first of the
    paragraphs &eacute; is a<b>b</b> and it is long enough to be taken by itself, as it should be.<br>Then.<p>Short.</p><div class="share-buttons">Share it</div><form>Name <input></form>
    <section id="comments"><p>The comment of a reader is here and it is long as the words in it are many.</p></section></article><aside>Side</aside><footer>&copy; all</footer>"""
    want = "Head & line The first of the paragraphs é is ab and it is long enough to be taken by itself, as it should be. Then. Short."
    assert html.main_text(page) == want
    assert html.main_text("<div><p>Of the</div><nav><p>x</nav>") == "Of the"
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<article><p>Only</article>") == "Only"
    assert html.main_text("<div class='ad'>x<article><p>In the end</article>") == "In the end"
    rows = [(1, "u", page, "z"), (1, "u", page, "z"), (None, None, None, "z"), (BIG, "v", "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", len(want)), ("1", len(want)), ("None", 0), (str(BIG), 0)])
    assert html.extract(df.limit(0)).count() == 0


def test_html_keeps_articles_in_wrappers():
    p = "<p>The first of the paragraphs is here and it is long enough to be taken by itself, as it should be.</p>"
    text = p[3:-4]
    for page, want in (
        (f'<div class="layout has-sidebar"><h1>Head</h1>{p}</div>', f"Head {text}"),
        (f'<article><div id="legal-history">{p}</div></article>', text),
        (f'<article><header class="entry-header"><h1>Head</h1></header>{p}</article>', f"Head {text}"),
        (f'<header><h1>Site</h1></header><div role="main"><div><p>In it</div>{p}</div><p>x</p>', f"In it {text}"),
        (f'<div class="content-sidebar-wrap">{p}<div class="post-comments">{p}</div><div class="ad-300x250">{p}</div></div>', text),
        (f'<div class="site-footer">{p}</div>{p}<div class="cookie-notice">{p}</div>', text),
    ):
        assert html.main_text(page) == want, page


def test_html_density_decides():
    """Nothing here names itself: only stop words, links and length tell the blocks apart."""
    good = "It was in the days of the old king that the men of the hill had come to the sea, and they were with us."
    poor = "Widget Pro 2000 Deluxe Steel Frame Blue Large Package Price Reduced Offer Shipping Weekend Stock Item"
    page = f"<div><a href=/a>one of the links that is here and long enough for the rules to look at it, as it is</a></div><div>Home</div><div>{poor}</div><div>Mid</div><div>{good}</div><div>And so.</div><div>{good}</div><div>{poor}</div><div>Bye</div>"
    assert html.main_text(page) == f"Mid {good} And so. {good}"
    found = html.classify(html.blocks(page))
    assert [b.label for b in found] == [False, False, False, True, True, True, True, False, False]
    inside = f"<article><div>{good}</div><ul><li><a href=/a>A linked line inside of the article</a></li></ul><p>{poor}</p></article>"
    assert html.main_text(inside) == good  # the poor one's nearest decided neighbour is the line of links
    foreign = "Den gamle kongen bodde lenge ved havet med alle sine menn, og ingen visste hvor skipene seilte hen om vinteren."
    assert html.main_text(f"<body><div>{foreign}</div><div><a href=/a>{foreign}</a></div></body>") == foreign
    assert html.main_text(f"<body><div>{foreign}</div><article><p>{good}</p></article></body>") == good
    link = "<p><a href=/x>The whole story of the king and of the men who were with him in those days</a>, it is said.</p>"
    assert html.main_text(f"<article><p>{good}</p>{link}</article>").endswith("in those days, it is said.")
    for name in ("reader-feedback", "user-discussion", "community-thread-list"):
        assert html.main_text(f'<article><p>{good}</p><section class="{name}"><p>{good}</p></section></article>') == good
    for name in ("discussion", "feedback-theory", "user-guide"):
        assert html.main_text(f'<article><p>{good}</p><section class="{name}"><p>{good}</p></section></article>') == f"{good} {good}"


def brute_text(page):
    """The same rules over a tree, for pages whose elements are all closed and none of whose dropped elements
    holds a main one (which would count as never closed): None."""
    from html.parser import HTMLParser

    blocks, stack = [], []  # block: text, linked, region; stack: tag, region, dropped
    regions, odd = iter(range(1, 10**6)), []

    class Walk(HTMLParser):
        def begin(self, tag=""):
            blocks.append(["", 0, next((r for _, r, _ in reversed(stack) if r), 0), tag])

        def handle_starttag(self, tag, attrs):
            inside = any(r for _, r, _ in stack)
            names = [n for k, v in attrs if k in ("class", "id", "role") for n in (v or "").split()]
            beside = tag in html.DROPPED or tag in html.RAW.split("|") or tag == "header" and not inside or tag not in html.MAIN and any(html._names_something(n, inside) for n in names)
            dropped = beside or any(d for _, _, d in stack)
            odd.append(dropped and tag in html.MAIN)
            main = not dropped and (tag in html.MAIN or ("role", "main") in attrs)
            stack.append((tag, next(regions) if main else 0, dropped))
            if tag in html.BLOCKS:
                self.begin(tag)

        def handle_endtag(self, tag):
            stack.pop()
            if tag in html.BLOCKS:
                self.begin()

        def handle_data(self, data):
            if not any(d for _, _, d in stack):
                if not blocks:
                    self.begin()
                blocks[-1][0] += data
                blocks[-1][1] += len(data) * any(t == "a" for t, _, _ in stack)

    Walk(convert_charrefs=True).feed(page)
    if any(odd):
        return None
    own = [(" ".join(t.split()), n, r, tag) for t, n, r, tag in blocks if t.split()]
    share_of = lambda t: sum(html._EDGES.sub("", w) in html.STOP_WORDS for w in t.lower().split()) / len(t.split())
    linked = lambda t, n, r, tag: n > html.LINKS * len(t) and not (r and tag == "p")
    strange = not any(r for _, _, r, _ in own) and all(share_of(b[0]) < html.STOP_LOW for b in own if len(b[0]) >= html.SHORT and not linked(*b))
    first = []
    for t, n, r, tag in own:
        share = share_of(t)
        if linked(t, n, r, tag):
            first.append(False)
        elif len(t) < html.SHORT:
            first.append(None)
        else:
            first.append(True if share >= html.STOP_HIGH or strange else None if r or share >= html.STOP_LOW else False)
    out = []
    for i, (t, _, r, _) in enumerate(own):
        near = sorted((abs(i - j), not x) for j, x in enumerate(first) if x is not None and own[j][2] == r)
        keep = first[i] if first[i] is not None else not near[0][1] if near else bool(r) or not any(x[2] for x in own)
        if keep:
            out.append(t)
    return " ".join(out)


def test_html_against_brute_force():
    random.seed(16)
    stop, other = ["the", "of", "and", "is", "that"], ["stone", "river", "cloud", "lamp", "grain", "x1"]

    def some(depth):
        if depth == 0 or random.random() < 0.3:
            words = " ".join(random.choice(stop if random.random() < (q := random.choice([0.1, 0.5])) else other) for _ in range(random.choice([1, 3, 30])))
            return f"<a href=/x>{words}</a>" if random.random() < 0.25 else words
        tag = random.choice(["div", "p", "section", "article", "main", "header", "nav", "aside", "span", "ul"]) if depth > 1 else random.choice(["p", "div", "li", "h2"])
        mark = random.choice(["", "", "", ' class="has-sidebar"', ' class="ad"', ' id="comments"', ' class="entry-header"', ' role="main"', ' class="page-header x"'])
        mark = "" if tag in ("article", "main", "span", "p") else mark
        return f"<{tag}{mark}>" + "".join(some(depth - 1) for _ in range(random.randrange(1, 5) if tag not in ("p", "span", "h2") else 0)) + ("text of it" if tag in ("p", "span", "h2") else "") + f"</{tag}>"

    compared = 0
    for _ in range(600):
        page = "<body>" + "".join(some(4) for _ in range(3)) + "</body>"
        if (want := brute_text(page)) is not None:
            assert html.main_text(page) == want, page
            compared += bool(want)
    assert compared > 100


def test_toxicity(spark):
    random.seed(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 8 == 0
        ws = [random.choice(["the", "sea", "is", "blue", "and", "green", "hill"]) for _ in range(random.randrange(5, 60))]
        if bad:
            for _ in range(2):
                ws.insert(random.randrange(len(ws)), random.choice(["zonk", "blarg", "frotz"]))
        rows.append((i, " ".join(ws), "s"))
        labels.append((i, 1, int(bad)))
    d = docs(spark, rows + [(None, None, "s"), (BIG, "", "s"), (0, rows[0][1], "s")])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == 3003 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 3000]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out) and len(out) > 500
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in out)
    assert right / len(out) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, BIG))
    none = toxicity.toxicity(d, lab.limit(0))
    assert none.where("score <> 0").count() == 0 and toxicity.toxicity(docs(spark, []), lab).count() == 0


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    rows = rows_of(["we'll  see 'S\n\n x\t", "à   b", "no\x00null", "“q” — €5 ...", "Übermaß 12345 ½ x²", "word " * 3000])
    want = []
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode_decode(docs(spark, rows)).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert bpe.encode_decode(docs(spark, [])).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = token_shards.feistel(np.arange(n), n, 9)
        assert sorted(p.tolist()) == list(range(n))
    assert token_shards.feistel(np.arange(1000), 1000, 9).tolist() != token_shards.feistel(np.arange(1000), 1000, 10).tolist()


def plain_feistel(x, n, key):
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, full = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(token_shards.ROUNDS):
            k = int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "big")
            f = ((right ^ k) * 0x9E3779B97F4A7C15) & full
            f = ((f ^ (f >> 29)) * 0xBF58476D1CE4E5B9) & full
            left, right = right, left ^ ((f >> 32) & mask)
        x = left << half | right
        if x < n:
            return x


def test_token_shards(spark, monkeypatch):
    """Shards byte by byte against a plain layout, for two splits of the table, and read from the middle."""
    monkeypatch.setattr(token_shards, "SHARD", 7)
    rows = rows_of([" ".join(f"w{k}" for k in range(n)) for n in (5, 500, 900)])
    enc = token_shards._encoding(token_shards.default_ranks())
    dealt = sorted((r.stream, r.h, r.d or "", r.text or "") for r in token_shards.streamed(docs(spark, rows)).collect())
    assert len({x[0] for x in dealt}) > 2
    sequences = []
    for stream in sorted({x[0] for x in dealt}):
        ids = [i for x in dealt if x[0] == stream for i in [*enc.encode_ordinary(x[3]), token_shards.END]]
        for k in range(0, len(ids), 64):
            own = ids[k : k + 64]
            sequences.append((np.array(own + [token_shards.END] * (64 - len(own)), "<u2").tobytes(), len(own)))
    n = len(sequences)
    slots = {plain_feistel(k, n, 5): x for k, x in enumerate(sequences)}
    assert sorted(slots) == list(range(n)) and n > 14
    body = b"".join(slots[k][0] for k in range(n))
    for split in (1, 5):
        index, folder = token_shards.materialise(docs(spark, rows).repartition(split), key=5, length=64)
        got = sorted(tuple(r) for r in token_shards.read_back(index, folder, 64).collect())
        assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(k, k // 7, k % 7 * 128, slots[k][1], hashlib.sha256(slots[k][0]).hexdigest()) for k in range(n)]
        store, path = media._store(folder)
        files = [store.open_input_file(f"{path}/{s:08d}.bin").read() for s in range(-(-n // 7))]
        assert b"".join(files) == body and b"".join([files[1][3 * 128 :], *files[2:]]) == body[10 * 128 :]
    empty, _ = token_shards.materialise(docs(spark, []), length=64)
    assert empty.count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= 80 * (len(a) + len(b) - k):
                    up[find(i)] = find(j)
    out = []
    for i, (x, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((x, len(sets[i]), (min(ids) if ids else None) if sets[i] else x))
    return out


def near_copies():
    random.seed(3)
    out = []
    for n in (8, 30, 60, 60):
        base = [f"w{random.randrange(3000)}" for _ in range(n)]
        for _ in range(18):
            w = list(base)
            for _ in range(random.randrange(3)):
                w[random.randrange(len(w))] = f"z{random.randrange(10**6)}"
            out.append(" ".join(w + [f"y{random.randrange(99)}" for _ in range(random.choice([0, 0, 3, 9]))]))
    return out


def test_jaccard(spark):
    rows = rows_of(near_copies())
    got = jaccard.near_duplicates(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_components(rows)))
    kept = jaccard.best_of_each(docs(spark, rows).drop("_w", "k")).collect()
    comps = brute_components(rows)
    assert len([r for r in kept if shingles(r.text)]) == len({c for i, n, c in comps if n and c is not None}) + len([1 for i, n, c in comps if n and c is None])
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def brute_repeats(rows, length, over_words=0):
    seen, want = {}, []
    for _, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    for i, t, _ in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone.update(range(p, p + length))
        runs = [p for p in sorted(gone) if p - 1 not in gone]
        for p in runs if over_words else []:
            end = next(q for q in range(p, len(b) + 1) if q not in gone)
            if len(b[p:end].split()) <= over_words:
                gone -= set(range(p, end))
        want.append((i, len(b), len(gone), sum(p - 1 not in gone for p in gone), hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in gone)).hexdigest()))
    return want


@pytest.mark.parametrize("hot, length, over_words", [(256, 400, 0), (2, 400, 0), (256, 250, 30), (2, 250, 30)])
def test_suffix(spark, hot, length, over_words):
    random.seed(4)
    rnd = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passages = [rnd(n) for n in (380, 400, 401, 450, 700, 1500)]
    texts = []
    for _ in range(50):
        t = rnd(random.randrange(300))
        for _ in range(random.randrange(3)):
            p = random.choice(passages)
            t += p[random.randrange(80) : len(p) - random.randrange(60)] + rnd(random.randrange(200))
        texts.append(t)
    rows = rows_of([*texts, passages[5], passages[5], "a" * 1000, "a" * 399, "b" * 400, "c" * 401])
    got = suffix.remove_repeats(docs(spark, rows).repartition(3), hot=hot, length=length, over_words=over_words).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_repeats(rows, length, over_words)))
    assert suffix.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_shared_runs(spark):
    """Runs of over 50 words that another row has too show even below 400 bytes; what is removed stays the same."""
    random.seed(12)
    some = lambda n: " ".join(f"{random.randrange(10**6):x}" for _ in range(n))
    runs = {n: " ".join(random.choice("abcdefg") + random.choice("hijk") for _ in range(n)) for n in (51, 60, 130)}
    shared = [some(90) + sep + runs[n] + "\n" + some(40) for n in runs for sep in (" ", "\n\n")]
    inside = some(20) + " " + " ".join([some(55)] * 2)
    short = some(39)
    long = " ".join(f"x{k}" for k in range(300_000)) + " " + runs[60] + " tail"
    clean = [some(200) for _ in range(20)] + [inside, short + " a " + some(30), short + " b " + some(30), "", None, some(50), "z" * (suffix.CHUNK * 2)]
    copies = [some(51)] * 2
    rows = rows_of([*shared, long, *copies, *clean])
    all_ = suffix.remove_repeats(docs(spark, rows).repartition(3), run_words=51).collect()
    got = {r.doc_id: r for r in all_}
    n = len(shared) + 1 + len(copies)
    assert len(runs[51].encode()) < 400 and sorted(i for i in got if i is not None and got[i].n_shared_grams) == list(range(1000, 1000 + n))
    plain = suffix.remove_repeats(docs(spark, rows)).collect()
    assert sorted(map(key, plain)) == sorted(map(key, [r[:5] for r in all_]))
    assert suffix.remove_repeats(docs(spark, []), run_words=51).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
def test_suffix_with_colliding_hashes(spark, hot, monkeypatch):
    """Where all prefix hashes are weak, bytes and digests still tell strings apart."""
    monkeypatch.setattr(suffix, "mix", lambda h: h & np.uint64(7))
    random.seed(8)
    rnd = lambda n: "".join(random.choice("ab ") for _ in range(n))
    p = rnd(600)
    rows = [(i, rnd(300) + p[i * 20 : i * 20 + 450] + rnd(200), "s") for i in range(8)]
    z = suffix.Sizes()
    with np.errstate(over="ignore"):
        texts = [t.encode() for _, t, _ in rows]
        found = [(text, rec) for text, rec in suffix.text_anchors(texts, z)]
        c = np.zeros(sum(len(r) for _, r in found), z.context)
        at = 0
        for text, rec in found:
            for t, x in zip(text.tolist(), rec):
                raw = texts[t]
                c[at]["key"], c[at]["t1"], c[at]["pos"], c[at]["left"], c[at]["right"], c[at]["mult"] = 1, t, x["pos"], x["left"], x["right"], 1
                whole = bytes(z.left) + raw + bytes(z.length)
                c[at]["raw"] = np.frombuffer(whole[int(x["pos"]) : int(x["pos"]) + z.left + z.length], np.uint8)
                at += 1
        spans = suffix._shared(z, c)
    for s in spans:
        string = texts[s["t1"]][s["a"] : s["b"]]
        assert len(string) >= 400 and sum(string[:400] in t for t in texts) > 1


def test_anchors_of_long_texts(monkeypatch):
    random.seed(5)
    text = "".join(random.choice("abcd ") for _ in range(30_000)).encode()
    with np.errstate(over="ignore"):
        (_, whole), = suffix.text_anchors([text])
        monkeypatch.setattr(suffix, "CHUNK", 4096)
        parts = np.concatenate([r for _, r in suffix.text_anchors([text])])
    assert whole["pos"].tolist() == parts["pos"].tolist() and whole["ctx"].tolist() == parts["ctx"].tolist()


def test_suffix_order():
    random.seed(6)
    n, z = 300, suffix.Sizes()
    c = np.zeros(n, z.context)
    c["raw"] = np.random.default_rng(1).integers(97, 99, (n, z.left + z.length))
    c["raw"][:, : z.left + z.k] = 97
    c["left"], c["right"] = z.left, np.random.default_rng(2).integers(z.k, z.length + 1, n)
    with np.errstate(over="ignore"):
        right, _ = suffix._halves(z, c)
        order = suffix.Suffixes(right, c["raw"][:, z.left :], c["right"]).sort(np.zeros(n, np.int64))
    texts = [c["raw"][i, z.left : z.left + int(c["right"][i])].tobytes() for i in range(n)]
    assert [texts[i] for i in order] == sorted(texts)


@pytest.mark.parametrize("sent", [0, 1000])
def test_pairs_across_components(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "SENT", sent)
    random.seed(15)
    rows = [(g, g * 1000 + i, random.choice([4, 5, 6, 7, 8, 10, 12, 60, 64, 75, 80]), random.randrange(3), random.randrange(6)) for g in range(3) for i in range(60)]
    want = set()
    for x in rows:
        for y in rows:
            (gx, sx, nx, px, cx), (gy, sy, ny, py, cy) = x, y
            if gx == gy and sx < sy and cx != cy and 100 * min(nx, ny) >= 80 * max(nx, ny) and 180 * min(nx - px, ny - py) >= 80 * (nx + ny):
                want.add((sx, sy))
    got = jaccard._across(spark.createDataFrame(rows, "g long, s long, n long, p long, c long")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_names_of_sets():
    with np.errstate(over="ignore"):
        a, b = np.arange(5, dtype=np.uint64), np.arange(6, dtype=np.uint64)
        assert jaccard.named(a, frozenset()) == jaccard.signature(a) != jaccard.signature(a, 1)
        assert jaccard.named(a, frozenset([jaccard.signature(a)])) == jaccard.signature(a, 1) and jaccard.signature(a) != jaccard.signature(b)


def test_html_goes_on_after_empty_and_open_elements():
    for x in ('<svg class="icon" viewBox="0 0 1 1"/>', "<math/>", "<svg><path/>", "<video src=x>", "<select><option>", "<svg><p>no</p></svg>", "<script src=x/>no</script>"):
        assert html.main_text(f"<article><p>Before</p>{x}<p>After</p></article>") == "Before After", x
    assert html.main_text("<article><p>Before</p><script>never closed <p>no</p>") == "Before"
    assert html.main_text("<article><p>A</p><svg/><p>B</p><svg><text>no</text></svg><p>C</p></article>") == "A B C"


def test_ftrl_against_a_plain_loop():
    """The algorithm as published, one coordinate after the other in dictionaries."""
    import math

    rnd = random.Random(12)
    examples = []
    for _ in range(120):
        y = int(rnd.random() < 0.3)
        own = {rnd.randrange(40) for _ in range(6)} | ({100 + rnd.randrange(3)} if y else set())
        examples.append((np.array(sorted(own), np.uint32), y))
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return -(zi - math.copysign(toxicity.L1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    def shift():
        return -bias[0] * toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias[1]))

    for epoch in range(3):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            x, y = examples[k]
            own, b = {int(i): weight(int(i)) for i in x}, shift()
            g = 1 / (1 + math.exp(-(sum(own.values()) + b))) - y
            for i, w in own.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w, n.get(i, 0.0) + g * g
            bias = [bias[0] + g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / toxicity.ALPHA * b, bias[1] + g * g]
    got, shifted = toxicity.ftrl(examples, 3)
    want = {i: weight(i) for i in z}
    assert math.isclose(shifted, shift(), rel_tol=1e-9) and set(np.flatnonzero(got)) == {i for i, w in want.items() if w}
    assert all(math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-12) for i, w in want.items()) and 0 < len(np.flatnonzero(got)) < len(want)
