"""Loading transforms: people, texts, links and relations from semi-structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARABIC, Lexicon, is_explicit, normalize


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def term_of(verbs: Column, lex: Lexicon) -> Column:
    """The last verb that states hearing, else the last verb, else null."""
    heard = F.filter(verbs, lambda v: is_explicit(v, lex))
    return F.coalesce(F.try_element_at(heard, F.lit(-1)), F.try_element_at(verbs, F.lit(-1)))


def chain_links(names: Column, compiler: Column, lex: Lexicon = ARABIC) -> Column:
    """array<struct<step, student, sheikh, term>> from array<struct<id, verbs>>: each known name hears
    from the next. A name without id breaks the chain: no link across it. A person twice in a row makes
    no link; steps count links; a link's term is the one after the student's name."""
    kind = "array<struct<step:int,student:bigint,sheikh:bigint,term:string>>"
    start = F.struct(compiler.cast("bigint").alias("student"), F.lit(None).cast("string").alias("term"), F.array().cast(kind).alias("links"))

    def step(acc, x):
        link = F.struct((F.size(acc.links) + 1).cast("int").alias("step"), acc.student.alias("student"), x.id.cast("bigint").alias("sheikh"), acc.term.alias("term"))
        add = acc.student.isNotNull() & x.id.isNotNull() & (acc.student != x.id)
        term = F.when(x.id.isNotNull(), term_of(x.verbs, lex))
        return F.struct(x.id.cast("bigint").alias("student"), term.alias("term"), F.when(add, F.concat(acc.links, F.array(link))).otherwise(acc.links).alias("links"))

    return F.aggregate(names, start, step, lambda acc: acc.links)


def build_links(records: DataFrame, lex: Lexicon = ARABIC) -> DataFrame:
    """text_id, step, student, sheikh, term of records (text_id, compiler, branches array<array<struct>>):
    all branches' links, the first of equal (step, student, sheikh) kept."""
    rows = records.select("text_id", "compiler", F.posexplode("branches").alias("b", "names"))
    links = rows.select("text_id", "b", F.inline(chain_links(F.col("names"), F.col("compiler"), lex)))
    return links.groupBy("text_id", "step", "student", "sheikh").agg(F.min_by("term", "b").alias("term"))


def relations(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct (teacher, student) from lists (id, teachers, students), unknown ids and self pairs out."""
    both = lists.select(F.explode("teachers").alias("teacher"), F.col("id").alias("student")).unionByName(lists.select(F.col("id").alias("teacher"), F.explode("students").alias("student")))
    both = both.where("teacher <> student").distinct()
    return both.join(known.select(F.col("id").alias("teacher")), "teacher", "left_semi").join(known.select(F.col("id").alias("student")), "student", "left_semi").select("teacher", "student")


def kunya(header: Column, name: Column) -> Column:
    """The by-name in segments two to five of the header's first sentence, unless the name begins with it."""
    first = F.regexp_extract(F.coalesce(header, F.lit("")), r"^([^.\n]*)", 1)
    parts = F.transform(F.slice(F.split(first, "،"), 2, 4), lambda s: F.regexp_extract(F.trim(s), r"^((?:أبو|أم|ابن)\s+\S+(?:\s+(?:الله|الرحمن|الملك|العزيز))?)", 1))
    return F.try_element_at(F.filter(parts, lambda p: (p != "") & ~F.coalesce(F.startswith(name, p), F.lit(False))), F.lit(1))


def people(entries: DataFrame) -> DataFrame:
    """People of registry entries (id, name, header, fields map): cleaned, cut to their columns' lengths."""
    field = lambda k: blank_to_null(F.try_element_at("fields", F.lit(k)))
    name = F.coalesce(blank_to_null(F.col("name")), blank_to_null(F.col("header")))
    cut = lambda c, n: F.left(c, F.lit(n))
    return entries.select("id", cut(name, 500).alias("name"), cut(F.coalesce(field("kunya"), kunya(F.col("header"), F.col("name"))), 200).alias("kunya"), cut(field("generation"), 150).alias("generation"), cut(field("residence"), 500).alias("residence"), cut(field("verdict"), 500).alias("verdict"))


def evaluations(entries: DataFrame, source: str, unnamed: str = "غير منسوب") -> DataFrame:
    """Quotes (critic, via, text) of entries as evaluations; blank texts go."""
    q = entries.select(F.col("id").alias("person"), F.inline("quotes"))
    said = F.concat(F.trim("text"), F.when(blank_to_null(F.col("via")).isNotNull(), F.concat(F.lit(" (رواية: "), F.trim("via"), F.lit(")"))).otherwise(""))
    return q.where(blank_to_null(F.col("text")).isNotNull()).select("person", F.coalesce(blank_to_null(F.col("critic")), F.lit(unnamed)).alias("scholar"), said.alias("text"), F.lit(source).alias("source"))


def texts(records: DataFrame, book: str, lex: Lexicon = ARABIC) -> DataFrame:
    """Texts of records (id, number, kind, arabic, chapter, bab, parts array<struct<type, start, end>>):
    the isnad is the valid isnad spans, one a line."""
    body = F.col("arabic")
    spans = F.filter("parts", lambda p: (p.type == "isnad") & (p.start >= 0) & (p.end > p.start) & (p.end <= F.length(body)))
    isnad = F.array_join(F.transform(spans, lambda p: F.trim(body.substr(p.start + 1, p.end - p.start))), "\n")
    return records.where("kind <> 'text' AND trim(arabic) <> ''").select(F.col("id"), F.coalesce("number", "id").alias("number"), body.alias("matn"), normalize(body, lex).alias("norm"), F.lit(book).alias("book"), F.coalesce("chapter", "bab").alias("chapter"), F.nullif(isnad, F.lit("")).alias("isnad"))


def carry_down(rows: DataFrame, keys: list[str], order: list[str], header: Column, value: Column, name: str) -> DataFrame:
    """Rows with the value of the last header row at or above them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(header, value), ignorenulls=True).over(w))


def lowest_tier(people: DataFrame, given: DataFrame) -> DataFrame:
    """people with tadlis_tier lowered to the least of what they had and what given (id, tier) says."""
    new = given.groupBy("id").agg(F.min("tier").alias("_t"))
    return people.join(new, "id", "left").withColumn("tadlis_tier", F.least("tadlis_tier", "_t")).drop("_t")


#: What the dataset calls the times of a hearing, in the order of their codes.
TIMINGS = ("unknown", "before", "after", "both", "conflict")


def timing_code(c: Column, timings: tuple[str, ...] = TIMINGS) -> Column:
    """Code of a timing; unknown words and null count as the first."""
    at = F.array_position(F.array(*map(F.lit, timings)), F.coalesce(c, F.lit("")))
    return F.greatest(at - 1, F.lit(0)).cast("int")


def first_hearings(hearings: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """One hearing for each (sheikh, student), the first by pos; hearings: sheikh, student, pos, timing, claims
    as an array of (timing, quote, book). Evidence and book are those of the first claim that says the
    hearing's own timing, else of the first one; books (book, name) gives the books' names."""
    own = hearings.where("sheikh <> student").withColumn("_n", F.row_number().over(Window.partitionBy("sheikh", "student").orderBy("pos"))).where("_n = 1")
    same = F.filter("claims", lambda c: c["timing"] == F.col("timing"))
    claim = F.coalesce(F.get(same, F.lit(0)), F.get("claims", F.lit(0)))
    out = own.select("sheikh", "student", "timing", claim["quote"].alias("evidence"), claim["book"].alias("book"))
    if books is None:
        return out
    return out.join(books, "book", "left").withColumn("book", F.coalesce("name", "book")).drop("name")


def generation_label(code: Column) -> Column:
    """Label of a generation code 1 to 12."""
    names = ("الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة", "السادسة", "السابعة", "الثامنة", "التاسعة", "العاشرة", "الحادية عشرة", "الثانية عشرة")
    n = F.try_to_number(code, F.lit("99")).cast("int")
    return F.when(n.between(1, 12), F.element_at(F.array(*map(F.lit, names)), F.when(n.between(1, 12), n).otherwise(1)))


def rename_chapters(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts with the chapters of names (book, chapter, new) renamed."""
    return texts.join(names, ["book", "chapter"], "left").withColumn("chapter", F.coalesce("new", "chapter")).drop("new")


def same_person(mine: DataFrame, theirs: DataFrame, years: int = 5) -> DataFrame:
    """(id, other): each of theirs (other, name, death) with the person of mine (id, name, death) of that
    normalised name, one whose year of death is near (or unknown) before one whose isn't."""
    key = lambda c: normalize(F.trim(c), ARABIC)
    a, b = mine.select("id", key(F.col("name")).alias("k"), F.col("death").alias("d1")), theirs.select("other", key(F.col("name")).alias("k"), F.col("death").alias("d2"))
    near = F.coalesce(F.abs(F.col("d1") - F.col("d2")) <= years, F.lit(True))
    # people of one name and year are one, as are theirs: of each name only its years meet
    first = a.groupBy("k", "d1").agg(F.min("id").alias("id"))
    best = b.select("k", "d2").distinct().join(first, "k").groupBy("k", "d2").agg(F.min(F.struct((~near).alias("far"), "id")).alias("x")).select("k", "d2", "x.far", "x.id").withColumnsRenamed({"k": "_k", "d2": "_d"})
    one = b.join(best, (F.col("k") == F.col("_k")) & F.col("d2").eqNullSafe(F.col("_d")))
    return one.groupBy("other").agg(F.min_by("id", F.struct("far", "id")).alias("id"))


def book_names(books: DataFrame, names: DataFrame) -> DataFrame:
    """books (slug, title, ...) with book: the name given for the slug in names (slug, name), else the title."""
    return books.join(names.select("slug", "name"), "slug", "left").withColumn("book", F.coalesce("name", "title")).drop("name")


def with_chapters(records: DataFrame, index: DataFrame) -> DataFrame:
    """records (file, chapter, ...) with the chapter that index (file, title) gives for their file's name;
    blank titles give none, a record's own chapter counts first."""
    name = F.substring_index("file", "/", -1)
    titles = index.where(blank_to_null(F.col("title")).isNotNull()).groupBy(F.substring_index("file", "/", -1).alias("_f")).agg(F.min(F.trim("title")).alias("_t"))
    return records.withColumn("_f", name).join(titles, "_f", "left").withColumn("chapter", F.coalesce(blank_to_null(F.col("chapter")), "_t")).drop("_f", "_t")


def exact_side_entries(side: DataFrame, id_map: DataFrame) -> DataFrame:
    """The entry of side (side_id, ...) of each person of id_map (id, side_id, confidence) that is mapped
    exactly; of several the one of the least number."""
    sure = id_map.where("confidence = 'exact'").groupBy("id").agg(F.min(F.expr("try_cast(side_id AS bigint)")).alias("side_id"))
    return sure.join(side.withColumn("side_id", F.expr("try_cast(side_id AS bigint)")), "side_id")


def side_evaluations(entries: DataFrame, source: str, covered: str) -> DataFrame:
    """Quotes (critic, via, text, book) of side entries as evaluations, those from the covered book left out."""
    kept = entries.withColumn("quotes", F.filter("quotes", lambda q: ~F.coalesce(q["book"] == covered, F.lit(False))))
    return evaluations(kept, source)


def mixed_up_claims(people: DataFrame, claims: DataFrame, default: int = 2) -> DataFrame:
    """people with mixed_up, severity (the worst claimed, else the default), none_after (any) and note (the
    distinct texts) of claims (id, severity, none_after, text, pos); applied anew each time, so that what an
    earlier run left is gone."""
    said = claims.groupBy("id").agg(
        F.coalesce(F.max("severity"), F.lit(default)).alias("severity"), F.coalesce(F.bool_or("none_after"), F.lit(False)).alias("none_after"),
        F.left(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(blank_to_null(F.col("text")).isNotNull(), F.struct("pos", F.trim("text").alias("t"))))), lambda x: x["t"])), " — "), F.lit(1000)).alias("note"),
    )
    return people.drop("mixed_up", "severity", "none_after", "note").join(said.withColumn("mixed_up", F.lit(True)), "id", "left").withColumn("mixed_up", F.coalesce("mixed_up", F.lit(False)))


def unique_ids(entries: DataFrame, order: list[str]) -> DataFrame:
    """entries with id made unique: the second and later of an id get -2, -3, ... in the given order."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return entries.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.concat_ws("-", "id", "_n"))).drop("_n")


def scholar_evaluations(quotes: DataFrame, scholars: DataFrame, known: DataFrame) -> DataFrame:
    """person, scholar, text of quotes (narrator, scholar_id, text) about known people (id); scholars (id, name)
    without a name are called by their number."""
    s = scholars.select(F.col("id").alias("scholar_id"), F.trim("name").alias("_n"))
    q = quotes.where(blank_to_null(F.col("text")).isNotNull()).join(known.select(F.col("id").alias("narrator")), "narrator", "left_semi").join(s, "scholar_id", "left")
    return q.select(F.col("narrator").alias("person"), F.coalesce(blank_to_null(F.col("_n")), F.concat(F.lit("Alem "), F.col("scholar_id").cast("string"))).alias("scholar"), F.trim("text").alias("text"))


def chain_export(texts: DataFrame, links: DataFrame, people: DataFrame, books: tuple[str, ...], head: int = 400) -> DataFrame:
    """id, book, number, head, links (step, term, student, sheikh, by step) of the texts whose book's name holds any
    of books; links to people (id, name) that aren't known are left out."""
    wanted = F.exists(F.array(*map(F.lit, books)), lambda b: F.col("book").contains(b))
    t = texts.where(wanted).select("id", "book", "number", F.left("matn", F.lit(head)).alias("head"))
    name = lambda k: people.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name"))
    named = links.join(t.select(F.col("id").alias("text_id")), "text_id", "left_semi").join(name("student"), "student").join(name("sheikh"), "sheikh")
    per = named.groupBy(F.col("text_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("step", "term", F.col("student_name").alias("student"), F.col("sheikh_name").alias("sheikh")))).alias("links"))
    return t.join(per, "id", "left").withColumn("links", F.coalesce("links", F.array().cast(per.schema["links"].dataType)))
