"""Linking of names and records: by cover, by weighted evidence, spans against links made by hand, chains cut short."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..shared import written

#: Words that don't identify by themselves at the end of a name.
LIGHT = ("ابو", "ابن", "بن", "ام", "و")
#: Keys of the six books, those of the four, names and letters of their compilers.
SIX = ("bukhari", "muslim", "abudawud", "tirmidhi", "nasai", "ibnmajah")
FOUR = ("abudawud", "tirmidhi", "nasai", "ibnmajah")
THREE = ("abudawud", "tirmidhi", "nasai")
COMPILERS = {"البخاري": "bukhari", "مسلم": "muslim", "ابو داود": "abudawud", "الترمذي": "tirmidhi", "النسائي": "nasai", "ابن ماجه": "ibnmajah"}
LETTERS = {"bukhari": "خ", "muslim": "م", "abudawud": "د", "tirmidhi": "ت", "nasai": "س", "ibnmajah": "ق"}
GROUPS = {"الجماعه": SIX, "السته": SIX, "الاربعه": FOUR, "الخمسه": ()}
#: Symbols of a group; the word that leaves out, the joined "and", and words that say where or how.
WHOLE = {"ع": SIX, "٤": FOUR, "٣": THREE}
BUT, AND, WHERE = "سوي", "و", ("في", "تعليقا", "مقرونا", "حديثا", "حديث", "وهو", "وروي")


def likeness(a: Column, b: Column, light: Sequence[str] = LIGHT) -> Column:
    """How alike two arrays of words are: 1 if equal; 0.5 to 0.9 if one lies within the other in one piece
    (a single word first met at an end, and not a light one); else the share of words in common. Empty or
    null: 0."""
    pair = F.array_sort(F.array(*[F.struct(F.size(x).alias("n"), F.lit(k).alias("k"), x.alias("w")) for k, x in enumerate(F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))]))

    def score(p: Column) -> Column:
        part, whole = p[0], p[1]
        share = F.coalesce(F.try_divide(F.size(F.array_intersect(part["w"], whole["w"])), F.size(F.array_union(part["w"], whole["w"]))), F.lit(0.0))
        places = F.filter(F.sequence(F.lit(1), F.greatest(whole["n"] - part["n"] + 1, F.lit(1))), lambda i: F.slice(whole["w"], i, part["n"]) == part["w"])
        sole = lambda first: (part["n"] > 1) | (((first == 1) | (first == whole["n"])) & ~F.arrays_overlap(part["w"], F.array(*map(F.lit, light))))
        within = let(F.array_min(places), lambda first: F.when((part["n"] > 0) & first.isNotNull() & sole(first), 0.5 + 0.4 * part["n"] / whole["n"]))
        return F.when((whole["n"] > 0) & (part["w"] == whole["w"]), 1.0).otherwise(F.coalesce(within, share))

    return let(pair, score)


def align_spans(names: DataFrame, spans: DataFrame, ahead: int = 6, least: float = 0.6, light: Sequence[str] = LIGHT) -> DataFrame:
    """text_id, pos, at, likeness: each name (text_id, pos, words array) of a text and the span (text_id, at, words
    array) that it stands for: the most alike of the next so many behind the last one taken, the earliest of equals;
    null where none is alike enough. Names come in order of pos, spans of at; a text is one row, as long as its chain."""
    n = names.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("names"))
    s = spans.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("spans"))
    both = n.join(s, "text_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(s.schema["spans"].dataType)))
    pos, at = names.schema["pos"].dataType.simpleString(), spans.schema["at"].dataType.simpleString()
    found = f"array<struct<pos:{pos},at:{at},likeness:double>>"
    state = lambda next_, out: F.struct(next_.cast("int").alias("next"), out.cast(found).alias("out"))

    def step(acc: Column, name: Column) -> Column:
        near = F.slice("spans", acc["next"] + 1, ahead)
        scored = F.transform(near, lambda x, i: F.struct(F.round(likeness(name["words"], x["words"], light), 9).alias("s"), (-i).alias("i"), x["at"].alias("at")))
        best = F.array_max(F.filter(scored, lambda x: x["s"] >= least))
        row = F.struct(name["pos"].alias("pos"), best["at"].alias("at"), F.coalesce(best["s"], F.lit(0.0)).alias("likeness"))
        return state(F.when(best.isNull(), acc["next"]).otherwise(acc["next"] - best["i"] + 1), F.concat(acc["out"], F.array(row).cast(found)))

    done = F.aggregate("names", state(F.lit(0), F.array()), step, lambda acc: acc["out"])
    return both.select("text_id", F.inline(done))


def gold_report(rows: DataFrame) -> DataFrame:
    """Per book and method, per book, and in all (null where summed up): names, those with a gold link, how many
    of these are linked alike, otherwise, or not at all, and the share of those linked that are alike (null if
    none is). rows: book, method, ours, gold (ids, null: no link)."""
    has, ours = F.col("gold").isNotNull(), F.col("ours").isNotNull()
    same = F.count_if(has & ours & (F.col("ours") == F.col("gold")))
    linked = F.count_if(has & ours)
    return rows.rollup("book", "method").agg(
        F.count("*").alias("names"), F.count_if(has).alias("with_gold"), same.alias("alike"), (linked - same).alias("otherwise"),
        F.count_if(has & ~ours).alias("unlinked"), F.try_divide(same, linked).alias("precision"),
    )


def _kept(c: DataFrame, when: Column, flag: Column, how: str) -> DataFrame:
    """Of groups for which when holds, the rows with the flag, marked with how."""
    go = F.coalesce(when, F.lit(False))
    return c.withColumn("_go", go).where(~F.col("_go") | flag).withColumn("how", F.when(F.col("_go"), how).otherwise(F.col("how"))).drop("_go")


def _famous(c: DataFrame, w, among: Column, times: int) -> DataFrame:
    """c with _famous: the row among those meant whose fame is so many times the next one's (at least 1)."""
    order = w.orderBy(among.desc(), F.col("fame").desc(), "id")
    c = c.withColumn("_r", F.row_number().over(order)).withColumn("_f", F.lead(F.when(among, F.col("fame"))).over(order))
    return c.withColumn("_famous", (F.col("_r") == 1) & among & (F.col("_f").isNull() | (F.col("fame") >= times * F.greatest(F.lit(1), F.col("_f"))))).drop("_r", "_f")


def link_by_cover(cands: DataFrame, least: float = 0.6, times: int = 3) -> DataFrame:
    """name_id, id, how, cover: whom a name means, of candidates (name_id, id, cover, lineage, main, marked, fame):
    those who cover most of its words; of several those whose lineage begins as given, then those of the main
    register, then the one marked by what is said of them, then the one clearly the most famous (of those marked,
    if any). how: unique, cover, nasab, main, marker, fame; without id ambiguous, or low_cover below the least
    share. Null flags count as false, null fame as 0."""
    w = Window.partitionBy("name_id")
    false = lambda x: F.coalesce(F.col(x), F.lit(False))
    c = cands.select("name_id", "id", "cover", false("lineage").alias("lineage"), false("main").alias("main"), false("marked").alias("marked"), F.coalesce("fame", F.lit(0)).alias("fame"))
    count = lambda x: F.count_if(x).over(w)
    n = F.count("*").over(w)
    c = c.withColumn("_best", F.max("cover").over(w)).withColumn("how", F.when(n == 1, "unique").otherwise("cover")).where(F.col("cover") == F.col("_best"))
    c = _kept(c.withColumn("_n", n).withColumn("_k", count(F.col("lineage"))), (F.col("_n") > 1) & (F.col("_k") > 0), F.col("lineage"), "nasab")
    c = _kept(c.withColumn("_n", n).withColumn("_k", count(F.col("main"))), (F.col("how") == "nasab") & F.col("_k").between(1, F.col("_n") - 1), F.col("main"), "main")
    c = _kept(c.withColumn("_n", n).withColumn("_k", count(F.col("marked"))), (F.col("_n") > 1) & (F.col("_k") == 1), F.col("marked"), "marker")
    c = _famous(c.withColumn("_n", n).withColumn("_k", count(F.col("marked"))), w, F.col("marked") | (F.col("_k") == 0), times)
    c = _kept(c.withColumn("_any", F.bool_or("_famous").over(w)), (F.col("_n") > 1) & F.col("_any"), F.col("_famous"), "fame")
    low = F.col("_best") < least
    per = c.groupBy("name_id").agg(F.count("*").alias("n"), F.min("id").alias("one"), F.first("_best").alias("_best"), F.first("how").alias("how"))
    sure = ~low & (F.col("n") == 1)
    return per.select("name_id", F.when(sure, F.col("one")).alias("id"), F.when(low, "low_cover").when(~sure, "ambiguous").otherwise(F.col("how")).alias("how"), F.col("_best").alias("cover"))


def link_students(items: DataFrame, cands: DataFrame, times: int = 3) -> DataFrame:
    """item_id, id, how: whom an item (item_id) of a teacher's students means, of candidates (item_id, form, id,
    listed, fame) without the teacher, by its first form that has any: the one listed with the teacher (listed),
    of several the clearly most famous (listed_fame); else the only one (unique_unlisted), or of the item's first
    form, 0, the clearly most famous (fame_unlisted); without id ambiguous, unlisted, or missing."""
    w = Window.partitionBy("item_id")
    c = cands.select("item_id", "form", "id", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("fame", F.lit(0)).alias("fame")).distinct()
    c = c.withColumn("_first", F.min("form").over(w)).where("form = _first").withColumn("_k", F.count_if("listed").over(w)).withColumn("_n", F.count("*").over(w))
    c = _famous(c, w, F.col("listed") | (F.col("_k") == 0), times)
    k, n, famous = F.col("_k"), F.col("_n"), F.col("_famous")
    how = (
        F.when((k == 1) & F.col("listed"), "listed").when((k > 1) & famous, "listed_fame").when((k == 0) & (n == 1), "unique_unlisted")
        .when((k == 0) & (F.col("form") == 0) & famous, "fame_unlisted")
    )
    none = F.when(F.first("_k") > 1, "ambiguous").otherwise("unlisted")
    per = c.withColumn("how", how).groupBy("item_id").agg(F.min(F.when(F.col("how").isNotNull(), F.col("id"))).alias("id"), F.coalesce(F.min("how"), none).alias("how"))
    return items.select("item_id").distinct().join(per, "item_id", "left").select("item_id", "id", F.coalesce("how", F.lit("missing")).alias("how"))


def years_apart(a: Column, b: Column, turn: int = 100) -> Column:
    """Least distance of two years of which only the rest by turn is known."""
    return F.least(F.pmod(a - b, F.lit(turn)), F.pmod(b - a, F.lit(turn)))


#: What evidence for and against a pair weighs.
PAGE, MANY_PAGES, AGREES, DIFFERS = 6.0, 2.0, 1.5, -1.0
YEAR, YEAR_NEAR, YEAR_OFF, VERDICT_OFF = 3.0, 1.0, -3.0, -0.7


def weighed(pairs: DataFrame) -> DataFrame:
    """pairs with score, support and hard: their evidence in sum, how many kinds support it, and whether it is
    ruled out. pairs: left_id, right_id, name_score, votes and pages (of pages that cite the left one, those on
    which the right one stands), nisba and kunya (booleans), death_a and death_b (rest by 100), rank_a and rank_b,
    verdict_a and verdict_b; null: not known, which weighs nothing."""
    share = F.coalesce("votes", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("pages", F.lit(0)))
    page = F.coalesce("votes", F.lit(0)) > 0
    gap = years_apart(F.col("death_a"), F.col("death_b"))
    ranks = F.abs(F.col("rank_a") - F.col("rank_b"))
    starts = lambda x, y: F.startswith(F.col(x), F.concat(F.col(y), F.lit(" ")))
    verdict = (F.col("verdict_a") == F.col("verdict_b")) | starts("verdict_a", "verdict_b") | starts("verdict_b", "verdict_a")
    told = lambda c, yes, no: F.when(c, yes).when(~c, no)
    parts = [
        F.col("name_score"), F.when(page, PAGE * share + F.when(F.col("votes") >= 3, MANY_PAGES).otherwise(0.0)),
        told(F.col("nisba"), AGREES, DIFFERS), told(F.col("kunya"), AGREES, DIFFERS),
        F.when(gap == 0, YEAR).when(gap <= 2, YEAR_NEAR).when(gap > 2, YEAR_OFF),
        F.when(ranks == 0, AGREES).when(ranks > 1, DIFFERS), told(verdict, AGREES, VERDICT_OFF),
    ]
    total = reduce(lambda x, y: x + y, [F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])
    support = reduce(lambda x, y: x + y, [F.coalesce(c.cast("int"), F.lit(0)) for c in (F.col("nisba"), F.col("kunya"), gap <= 2, ranks == 0, verdict)])
    known = page & (share >= 0.5) & (F.col("name_score") >= 3.5)
    hard = (F.col("name_score") < 0) | (F.coalesce(gap > 2, F.lit(False)) & ~known)
    return pairs.withColumn("score", F.round(total, 6)).withColumn("support", support).withColumn("hard", F.coalesce(hard, F.lit(False))).withColumn("by_page", page)


def best_by_evidence(pairs: DataFrame) -> DataFrame:
    """left_id, right_id, score, margin, confidence: the pair of most evidence (ties: the least right_id), how far
    it leads the next (or -10), and exact, probable or none, which follow from both and from what supports it.
    pairs: as weighed() takes them. With main and lineage (of the right one), entries outside the main source
    that have the lineage of a best one within it, and no death that speaks against them, are the same person
    listed again: they don't count as next, and come as duplicates."""
    w = Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id")
    ranked = weighed(pairs).withColumn("_n", F.row_number().over(w))
    duplicates = {"main", "lineage"} <= set(pairs.columns)
    if duplicates:
        ahead = lambda c: F.first(c).over(w)
        again = (F.col("_n") > 1) & ahead("main") & ~F.col("main") & (F.size("lineage") > 0) & (F.col("lineage") == ahead("lineage")) & ~F.coalesce(years_apart(F.col("death_a"), F.col("death_b")) > 2, F.lit(False))
        ranked = ranked.withColumn("_again", F.coalesce(again, F.lit(False)))
    else:
        ranked = ranked.withColumn("_again", F.lit(False))
    whole = Window.partitionBy("left_id")
    ranked = ranked.withColumn("_next", F.coalesce(F.max(F.when((F.col("_n") > 1) & ~F.col("_again"), F.col("score"))).over(whole), F.lit(-10.0)))
    ranked = ranked.withColumn("duplicates", F.sort_array(F.collect_set(F.when(F.col("_again"), F.col("right_id"))).over(whole))) if duplicates else ranked
    top = ranked.where("_n = 1")
    margin = F.round(F.col("score") - F.col("_next"), 6)
    fair = ~F.col("hard") & (F.col("name_score") >= 2.5)
    exact = fair & (F.col("score") >= 8) & (margin >= 3) & (F.col("by_page") | (F.col("support") >= 3))
    confidence = F.when(exact, "exact").when(fair & (F.col("score") >= 5) & (margin >= 2), "probable").otherwise("none")
    return top.select("left_id", "right_id", "score", margin.alias("margin"), confidence.alias("confidence"), *["duplicates"] * duplicates)


def entries_on_pages(entries: DataFrame, pages: DataFrame, cell: int = 4096) -> DataFrame:
    """(book, page, entry): the entries printed on each page (book, page): those that start there, and the last
    one before it, which may go on. entries: book, entry (in the book's order), page. A book is cut into cells of
    so many pages; what goes on from one cell to the next is found from the cells' last entries."""
    at = F.floor(F.col("page") / cell).alias("cell")
    asked = pages.select("book", "page").distinct().select("book", "page", F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"))
    earlier = lambda *by: Window.partitionBy(*by).rangeBetween(Window.unboundedPreceding, -1)
    starts = F.when(F.col("entry").isNotNull(), F.struct("page", "entry"))
    both = entries.select("book", "page", "entry", at).union(asked.select("*", at)).withColumn("_s", starts)
    cells = both.groupBy("book", "cell").agg(F.max("_s").alias("_last")).select("book", "cell", F.max("_last").over(earlier("book").orderBy("cell")).alias("_before"))
    own = both.withColumn("_b", F.max("_s").over(earlier("book", "cell").orderBy("page"))).where("entry IS NULL").join(cells, ["book", "cell"])
    before = own.select("book", "page", F.coalesce("_b", "_before").alias("_b")).where("_b IS NOT NULL").select("book", "page", F.col("_b.entry").alias("entry"))
    return entries.select("book", "page", "entry").join(asked.select("book", "page"), ["book", "page"]).union(before).distinct()


def page_votes(cites: DataFrame, index: DataFrame, entries: DataFrame) -> DataFrame:
    """left_id, right_id, votes, pages: how many of a record's cites (left_id, book, vol, printed) fall on a page
    on which an entry stands, and how many of its cites are on known pages. index: book, vol, printed, page, the
    place of a printed page in its book; entries: book, entry, page."""
    per = cites.join(index, ["book", "vol", "printed"]).groupBy("left_id", "book", "page").agg(F.count("*").alias("n"))
    per = written(per, "cited-pages")
    total = per.groupBy("left_id").agg(F.sum("n").alias("pages"))
    on = written(entries_on_pages(entries, per), "entries-on-pages")
    met = per.join(on, ["book", "page"])
    return met.groupBy("left_id", F.col("entry").alias("right_id")).agg(F.sum("n").alias("votes")).join(total, "left_id").select("left_id", "right_id", "votes", "pages")


def join_heads(parts: DataFrame, relations: DataFrame) -> DataFrame:
    """text_id, part, pos, id of parts (text_id, part, pos from 0, id or null, complete) of which those cut short go
    on with the tail of the next complete part that fits: behind the person with whom the head ends, or from the
    first who taught that person by relations (teacher, student). Parts that nothing fits stay as they are."""
    head = parts.where("NOT complete AND id IS NOT NULL").groupBy("text_id", "part").agg(F.max("pos").alias("last"), F.max_by("id", "pos").alias("head"))
    tail = parts.where("complete AND pos > 0 AND id IS NOT NULL").select("text_id", F.col("part").alias("other"), F.col("pos").alias("k"), F.col("id").alias("j"))
    met = head.join(tail, "text_id").where("other > part")
    known = relations.select(F.col("student").alias("head"), F.col("teacher").alias("j"), F.lit(True).alias("_e")).distinct()
    fit = met.join(known, ["head", "j"], "left").where((F.col("j") == F.col("head")) | F.col("_e"))
    where = F.min(F.struct("other", "k", F.when(F.col("j") == F.col("head"), F.col("k") + 1).otherwise(F.col("k")).alias("start"))).alias("x")
    joined = fit.groupBy("text_id", "part", "last").agg(where).select("text_id", "part", "last", F.col("x.other").alias("other"), F.col("x.start").alias("start"))
    own = parts.join(joined.select("text_id", "part", "last"), ["text_id", "part"], "left").where(F.col("last").isNull() | (F.col("pos") <= F.col("last")))
    body = parts.where("complete").select("text_id", F.col("part").alias("other"), "pos", "id")
    added = joined.join(body, ["text_id", "other"]).where("pos >= start").select("text_id", "part", (F.col("last") + 1 + F.col("pos") - F.col("start")).cast(parts.schema["pos"].dataType).alias("pos"), "id")
    return own.select("text_id", "part", "pos", "id").unionByName(added)


def compilers_named(c: Column, names: dict[str, str] = COMPILERS, groups: dict[str, Sequence[str]] = GROUPS, where: Sequence[str] = WHERE) -> Column:
    """Keys of the compilers that an item of a list of students names, alone (perhaps with where or how he took
    it) or as a group, some of whom may be left out ("the six but Ibn Majah"); empty if it names somebody else,
    a name left out isn't known, or a critic's words follow behind a colon. The group of five says which five
    only by whom it leaves out of the six."""
    plain = F.translate(F.coalesce(c, F.lit("")), "أإآىة" + "ًٌٍَُِّْٰـ", "اااي" + "ه")
    w = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
    none = F.array().cast("array<string>")
    keys = F.create_map(*[x for name, own in {**{n: [k] for n, k in names.items()}, **groups}.items() for x in (F.lit(name), F.array(*map(F.lit, own)).cast("array<string>"))])
    mean = lambda phrase: F.try_element_at(keys, phrase)
    but = F.array_position(w, BUT).cast("int")
    # all words, or the one or two that make a name before a word of where
    cut = F.array_max(F.array(*[F.when(F.coalesce(F.get(w, F.lit(n)).isin(*where), F.lit(False)) & F.array_join(F.slice(w, 1, n), " ").isin(*names), n).otherwise(0) for n in (1, 2)]))
    alone = mean(F.array_join(F.when(cut > 0, F.slice(w, F.lit(1), cut)).otherwise(w), " "))
    left_out = F.transform(F.split(F.array_join(F.slice(w, but + 1, F.size(w)), " "), rf"\s{AND}(?=\S)|\s*،\s*"), lambda x: mean(F.trim(x)))
    group = F.when((but == 2) & F.get(w, F.lit(0)).isin(*groups), mean(F.get(w, F.lit(0))))
    of = F.when(F.size(group) > 0, group).otherwise(F.array(*map(F.lit, SIX)))
    others = F.when(group.isNotNull() & F.forall(left_out, lambda x: x.isNotNull()), F.array_except(of, F.flatten(left_out)))
    return F.when(plain.rlike("[:؛]"), none).otherwise(F.coalesce(F.when(but > 0, others).otherwise(alone), none))


def keys_of_symbols(symbols: Column, letters: dict[str, str] = LETTERS, whole: dict[str, Sequence[str]] = WHOLE) -> Column:
    """Keys of the compilers that symbols stand for: a symbol of its own for a group, or letters, which may be
    written together."""
    table = F.create_map(*[x for s, own in {**{v: [k] for k, v in letters.items()}, **whole}.items() for x in (F.lit(s), F.array(*map(F.lit, own)))])
    each = F.flatten(F.transform(F.split(F.coalesce(symbols, F.lit("")), r"\s+"), lambda x: F.when(x.isin(*whole), F.array(x)).otherwise(F.filter(F.split(x, ""), lambda y: y.isin(*letters.values())))))
    return F.array_distinct(F.flatten(F.transform(each, lambda x: F.try_element_at(table, x))))


def carries_symbol(symbols: Column, key: Column) -> Column:
    """Whether a person's symbols say that the compiler of that key transmits from them."""
    return F.coalesce(F.array_contains(keys_of_symbols(symbols), key), F.lit(False))


def compiles(name: Column, book: Column, starts: dict[str, str]) -> Column:
    """Whether a person's name begins as that of the book's compiler; starts: book -> beginning of a name."""
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), book)
    return F.coalesce(F.startswith(F.trim(name), start), F.lit(False))


def owner_of_book(book: Column, keys: Sequence[tuple[str, str]]) -> Column:
    """The compiler by whom a book is known: that of the first key its title holds, else the title itself. An
    article that melts into a preposition is restored first."""
    full = F.regexp_replace(book, r"(^|\s)لل", "$1ل ال")
    return F.coalesce(*[F.when(full.contains(k), F.lit(v)) for k, v in keys], book)


def book_coverage(names: DataFrame, headings: DataFrame) -> DataFrame:
    """Per book and over all books (book null): names that a heading there may stand for, and their occurrences.
    names: name, n, words array; headings: book, words array. A heading fits that begins with the name's first word
    and holds all its words; names are looked up by their rarest word alone, so a frequent word makes no pairs."""
    h = headings.where(F.size("words") > 0).select("book", F.array_distinct("words").alias("hw")).distinct().withColumn("_h", F.get("hw", F.lit(0)))
    index = h.select("book", "hw", "_h", F.explode("hw").alias("w"))
    n = names.where(F.size("words") > 0).select("name", "n", F.array_distinct("words").alias("nw"))
    counted = n.select("name", F.explode("nw").alias("w")).join(index.groupBy("w").agg(F.count("*").alias("of")), "w", "left")
    rarest = counted.groupBy("name").agg(F.min_by("w", F.struct(F.coalesce("of", F.lit(0)), "w")).alias("w"))
    met = n.join(rarest, "name").join(index, "w").where((F.get("nw", F.lit(0)) == F.col("_h")) & (F.size(F.array_except("nw", "hw")) == 0))
    hit = met.select("name", "n", "book").distinct()
    total = hit.select("name", "n").distinct().agg(F.count("*").alias("names"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    return hit.groupBy("book").agg(F.count("*").alias("names"), F.sum("n").alias("occurrences")).unionByName(total.select(F.lit(None).cast("string").alias("book"), "names", "occurrences"))
