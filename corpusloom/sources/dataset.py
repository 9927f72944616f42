"""The dataset's folder as tables: people, chains, numbered book files in their order, notes on people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ARABIC, Lexicon
from ..operators import etl

_NAME = "STRUCT<n:STRING,id:STRING,how:STRING,verbs:ARRAY<STRING>>"
#: What the files hold.
REGISTRY = "ARRAY<STRUCT<id:STRING,name:STRING,header:STRING,source:STRING,verdict:STRING,rank:INT,tabaqa:STRING,shuyukh:ARRAY<STRING>,talamidh:ARRAY<STRING>,quotes:ARRAY<STRUCT<critic:STRING,via:STRING,text:STRING>>>>"
CHAINS = f"STRUCT<book:STRING,compiler:STRING,chains:ARRAY<STRUCT<id:INT,number:INT,names:ARRAY<{_NAME}>,branches:ARRAY<ARRAY<{_NAME}>>>>>"
RECORDS = "ARRAY<STRUCT<id:INT,number:INT,kind:STRING,bab:STRING,vol:STRING,arabic:STRING,parts:ARRAY<STRUCT<type:STRING,start:INT,end:INT>>>>"
BOOK, INDEX = "STRUCT<slug:STRING,title:STRING>", "ARRAY<STRUCT<file:STRING,name_ar:STRING>>"
NARRATORS = "ARRAY<STRUCT<id:INT,death:INT,fields:MAP<STRING,STRING>,quotes:ARRAY<STRUCT<section:STRING,critic:STRING,text:STRING,book:STRING,vol:INT,page:INT>>>>"
MAPPING = "MAP<STRING,STRUCT<registry:STRING,confidence:STRING>>"
NOTES = (
    "STRUCT<mudallisin:ARRAY<STRUCT<id:STRING,tier:INT>>,mukhtalitun:ARRAY<STRUCT<id:STRING,ikhtilat:ARRAY<STRUCT<text:STRING>>,severity:ARRAY<STRUCT<value:STRING>>,no_one_after:ARRAY<STRING>,"
    "group_rules:ARRAY<STRUCT<group:STRING,timing:STRING,quote:STRING,book:INT>>,hearings:ARRAY<STRUCT<id:STRING,timing:STRING,claims:ARRAY<STRUCT<timing:STRING,quote:STRING,book:INT>>>>>>>"
)
#: Degrees of a late confusion, from the least; characters that are kept of a remark.
SEVERITIES, LONG = ("light", "disputed", "harmful"), 1000


def files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """folder, file, data, bad: each JSON file of a path (globs allowed) parsed as one value of the schema; bad
    holds what can't be parsed, data is null then. A file is one row, so files should be of bounded size, as the
    numbered ones of a book are."""
    raw = spark.read.text(path, wholetext=True)
    at = F.split(F.col("_metadata.file_path"), "/")
    data = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    parsed = raw.select(F.element_at(at, -2).alias("folder"), F.element_at(at, -1).alias("file"), "value", data.alias("data"))
    whole = F.col("data").isNotNull()
    return parsed.select("folder", "file", F.when(whole, F.col("data")).alias("data"), F.when(~whole, F.col("value")).alias("bad"))


def records(spark: SparkSession, root: str) -> DataFrame:
    """slug, title, file_no, chapter, place, id, number, kind, bab, vol, arabic, parts, bad: the records of all
    books, in the order file_no, place. Files are numbered, and numbers count as numbers (10 comes after 9); chapter
    is the name that the book's index gives the file, else the record's own. A broken file is one row with bad and
    no record."""
    own = files(spark, f"{root}/*/[0-9]*.json", RECORDS).withColumn("file_no", F.regexp_extract("file", r"^(\d+)\.json$", 1).try_cast("int")).where("file_no IS NOT NULL")
    books = files(spark, f"{root}/*/book.json", BOOK).select("folder", F.col("data.title").alias("title"))
    names = files(spark, f"{root}/*/index.json", INDEX).select("folder", F.inline("data")).select("folder", F.regexp_extract("file", r"(\d+)(?:\.json)?$", 1).try_cast("int").alias("file_no"), F.col("name_ar").alias("chapter"))
    names = names.where("trim(chapter) <> ''").dropDuplicates(["folder", "file_no"])
    each = own.select("folder", "file_no", "bad", F.posexplode_outer("data").alias("place", "r"))
    out = each.join(F.broadcast(books), "folder", "left").join(F.broadcast(names), ["folder", "file_no"], "left")
    return out.select(F.col("folder").alias("slug"), "title", "file_no", F.coalesce("chapter", "r.bab").alias("chapter"), "place", "r.*", "bad")


def registry(spark: SparkSession, root: str) -> DataFrame:
    """People of registry.json; rank 0 and blank verdicts count as none."""
    rows = files(spark, f"{root}/registry.json", REGISTRY).select(F.inline("data"))
    return rows.withColumn("rank", F.expr("nullif(rank, 0)")).withColumn("verdict", F.expr("nullif(trim(verdict), '')"))


def chains(spark: SparkSession, root: str) -> DataFrame:
    """slug, book, compiler, id, number, branches (one of names where a chain has none of its own); files whose
    names begin with _ are left out."""
    own = files(spark, f"{root}/chains/*.json", CHAINS).where(~F.startswith("file", F.lit("_")) & F.col("data").isNotNull())
    each = own.select(F.regexp_replace("file", r"\.json$", "").alias("slug"), "data.book", "data.compiler", F.inline("data.chains"))
    branches = F.when(F.size("branches") > 0, F.col("branches")).when(F.size("names") > 0, F.array("names"))
    return each.select("slug", "book", "compiler", "id", "number", branches.alias("branches"))


def mapped(spark: SparkSession, root: str, confidence: tuple[str, ...] = ("exact",)) -> DataFrame:
    """(id, registry): which person of the registry one of the encyclopedia is, where that is sure enough."""
    rows = files(spark, f"{root}/s1_registry_map.json", MAPPING).select(F.explode("data").alias("id", "m"))
    return rows.where(F.col("m.confidence").isin(*confidence) & F.col("m.registry").isNotNull()).select(F.col("id").try_cast("int").alias("id"), "m.registry")


def narrators(spark: SparkSession, root: str) -> DataFrame:
    """People of the encyclopedia: id, death, fields, quotes."""
    return files(spark, f"{root}/narrators.json", NARRATORS).select(F.inline("data"))


def notes(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """ilal.json as flat tables. masking: id, tier. mixed: id, severity (1 to 3, the worst that is given, else
    disputed), none_after (whatever its elements are), note (distinct remarks joined).
    hearings: sheikh, student, pos, timing, claims. rules: sheikh, pos, group, timing, quote, book; rules without
    group or quote are left out."""
    data = files(spark, f"{root}/ilal.json", NOTES).select("data.*")
    masking = data.select(F.inline("mudallisin")).where("id IS NOT NULL")
    each = data.select(F.inline("mukhtalitun")).where("id IS NOT NULL")
    said = F.array_distinct(F.filter(F.transform("ikhtilat", lambda x: x["text"]), lambda t: F.trim(t) != ""))
    levels = F.array(*map(F.lit, SEVERITIES))
    severity = F.array_max(F.filter(F.transform("severity", lambda x: F.array_position(levels, x["value"]).cast("int")), lambda v: v > 0))
    mixed = each.select("id", F.coalesce(severity, F.lit(SEVERITIES.index("disputed") + 1)).alias("severity"), (F.coalesce(F.size("no_one_after"), F.lit(0)) > 0).alias("none_after"), F.left(F.array_join(said, " — "), F.lit(LONG)).alias("note"))
    heard = each.select(F.col("id").alias("sheikh"), F.posexplode("hearings").alias("pos", "h"))
    hearings = heard.select("sheikh", F.col("h.id").alias("student"), "pos", F.col("h.timing").alias("timing"), F.coalesce("h.claims", F.array().cast("array<struct<timing:string,quote:string,book:int>>")).alias("claims"))
    ruled = each.select(F.col("id").alias("sheikh"), F.posexplode("group_rules").alias("pos", "r")).select("sheikh", "pos", "r.*")
    return {"masking": masking, "mixed": mixed, "hearings": hearings, "rules": ruled.where("trim(`group`) <> '' AND trim(quote) <> ''")}


def load(spark: SparkSession, root: str, lex: Lexicon = ARABIC) -> dict[str, DataFrame]:
    """The whole folder as the tables people, relations, texts, links, hearings and rules, and bad, the files that
    can't be parsed. Ids of people are hashes of the dataset's keys, those of texts of book and record, so that
    loading again gives the same; links name known people only."""
    who = lambda c: F.xxhash64(F.lit("person"), c)
    reg = registry(spark, root)
    fields = narrators(spark, root).join(F.broadcast(mapped(spark, root)), "id").groupBy(F.col("registry").alias("_k")).agg(F.min_by("fields", "id").alias("fields"))
    own = reg.join(fields, reg["id"] == fields["_k"], "left").drop("_k")
    people = etl.people(own.select(who(F.col("id")).alias("id"), "name", "header", "source", "verdict", "rank", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields")))
    known = people.select("id")
    keys = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), who)
    relations = etl.relations(reg.select(who(F.col("id")).alias("id"), keys(F.col("shuyukh")).alias("teachers"), keys(F.col("talamidh")).alias("students")), known)

    rec = records(spark, root)
    text_id = lambda slug: F.xxhash64(F.lit("text"), slug, F.col("id"))
    kept = rec.where("id IS NOT NULL").withColumn("id", text_id(F.col("slug")))
    own = etl.texts(kept, "", lex).drop("book").join(kept.select("id", F.coalesce("title", "slug").alias("book"), "slug", "file_no", "place"), "id")
    texts = own.select("id", "number", "matn", "norm", "isnad", "book", "chapter", "slug", "file_no", "place")
    ch = chains(spark, root).where("branches IS NOT NULL")
    named = F.transform("branches", lambda b: F.transform(b, lambda n: F.struct(F.when(n["id"].isNotNull(), who(n["id"])).alias("id"), F.coalesce(n["verbs"], F.array().cast("array<string>")).alias("verbs"))))
    built = etl.build_links(ch.select(text_id(F.col("book")).alias("text_id"), F.when(F.col("compiler").isNotNull(), who(F.col("compiler"))).alias("compiler"), named.alias("branches")), lex)
    links = built.join(texts.select(F.col("id").alias("text_id")), "text_id", "left_semi")
    for side in ("student", "sheikh"):
        links = links.join(known.select(F.col("id").alias(side)), side, "left_semi")

    n = notes(spark, root)
    heard = n["hearings"].select(who(F.col("sheikh")).alias("sheikh"), who(F.col("student")).alias("student"), "pos", etl.timing_code(F.col("timing")).alias("timing"),
        F.transform("claims", lambda c: F.struct(etl.timing_code(c["timing"]).alias("timing"), c["quote"].alias("quote"), c["book"].cast("string").alias("book"))).alias("claims"))
    both = known.select(F.col("id").alias("sheikh")), known.select(F.col("id").alias("student"))
    hearings = etl.first_hearings(heard.join(both[0], "sheikh", "left_semi").join(both[1], "student", "left_semi"))
    rules = n["rules"].select(who(F.col("sheikh")).alias("sheikh"), "pos", "group", etl.timing_code(F.col("timing")).alias("timing"), "quote", "book").join(both[0], "sheikh", "left_semi")
    tiers = n["masking"].groupBy(who(F.col("id")).alias("id")).agg(F.lit(True).alias("masks"), F.min("tier").alias("tadlis_tier"))
    mixed = n["mixed"].dropDuplicates(["id"]).select(who(F.col("id")).alias("id"), F.lit(True).alias("mixed_up"), "severity", "none_after", "note")
    people = people.join(tiers, "id", "left").join(mixed, "id", "left").na.fill(False, ["masks", "mixed_up", "none_after"])
    bad = rec.where("bad IS NOT NULL").select("slug", "file_no", "bad")
    return {"people": people, "relations": relations, "texts": texts, "links": links, "hearings": hearings, "rules": rules, "bad": bad}
