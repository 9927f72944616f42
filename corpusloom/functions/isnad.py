"""The names in a chain of transmission and the verbs between them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs of transmission as whole words, what ends a chain, and what ends a name.
VERBS = r"(?:حدثناه|أخبرناه|أنبأناه|حدثنا|حدثني|حدثه|أخبرنا|أخبرني|أخبره|أنبأنا|أنبأني|أنبأ|ثنا|نا|أنا|أبنا|قرئ على|قرأت على|قرأنا على|كنت أسمع|أسمع|سمعت|سمع|يحدثنا|يحدثه|يحدث|حدث|عن|قال|قالت|أن|يقول)"
CHAIN_END = r"رسول الله|نبي الله|نبى الله|النبي|النبى|ﷺ|صلى الله عليه وسلم"
#: What is said after a name, titles before it, and the words with which a name goes on behind a comma.
HONORIFICS = ("رضي الله عنه", "رضي الله عنها", "رضي الله عنهما", "رضي الله عنهم", "عليه السلام", "﵁", "﵂", "﵄", "﵃", "﵀")
TITLES = ("الشيخ", "الإمام", "الأستاذ", "القاضي", "الحافظ", "الفقيه", "الأديب")
GOES_ON = ("بن", "ابن", "بنت", "أبو", "أبي", "أبا", "يعني", "وهو")

_VERB = rf"(?:^|(?<=[\s،:]))و?({VERBS})(?=[\s،:])"


def chain_text(text: Column) -> Column:
    """The text without vowel marks, up to where the source is named."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ً-ْٰـ]", "")
    return F.regexp_extract(plain, rf"(?s)^(.*?)(?:{CHAIN_END}|\z)", 1)


def clean_name(c: Column) -> Column:
    """A name without a title, honorifics, footnote numbers and what follows a comma, unless the name goes on."""
    c = F.btrim(F.regexp_replace(F.regexp_replace(c, "\\(¬?[٠-٩0-9]+\\)", " "), "\\s+", " "))
    said = F.array_min(F.filter(F.array(*[F.locate(h, F.translate(c, "ى", "ي")) for h in HONORIFICS]), lambda at: at > 0))
    c = F.btrim(F.when(said.isNotNull(), c.substr(F.lit(1), said - 1)).otherwise(c))
    title = F.substring_index(c, " ", 1)
    c = F.when(title.isin(*TITLES) & (title != c), c.substr(F.length(title) + 2, F.length(c))).otherwise(c)
    parts = F.split(c, "،")
    ends = F.array_position(F.transform(parts, lambda x, i: (i > 0) & ~F.substring_index(F.ltrim(x), " ", 1).isin(*GOES_ON)), True)
    kept = F.when(ends > 0, F.slice(parts, 1, (ends - 1).cast("int"))).otherwise(parts)
    return F.btrim(F.array_join(kept, "،"), F.lit(" ،:.-"))


def segments(text: Column) -> Column:
    """array<struct<name, verbs>>: names in order, each with the verbs between it and the next name."""
    chain = F.concat(chain_text(text), F.lit(" "))
    pattern = rf"(?s){_VERB}((?:(?!{_VERB}).)*)"
    verbs, rest = F.regexp_extract_all(chain, F.lit(pattern), F.lit(1)), F.regexp_extract_all(chain, F.lit(pattern), F.lit(2))
    pairs = F.zip_with(verbs, rest, lambda v, r: F.struct(v.alias("verb"), clean_name(r).alias("name")))
    kind = "struct<out:array<struct<name:string,verbs:array<string>>>,open:array<string>>"
    head = clean_name(F.regexp_extract(chain, rf"(?s)^(.*?)(?:{_VERB}|\z)", 1))

    def step(acc, x):
        verbs = F.concat(acc.open, F.array(x.verb))
        last = F.size(acc.out)
        closed = F.transform(acc.out, lambda s, i: F.struct(s["name"].alias("name"), F.when(i == last - 1, verbs).otherwise(s["verbs"]).alias("verbs")))
        grown = F.concat(closed, F.array(F.struct(x["name"].alias("name"), F.array().cast("array<string>").alias("verbs"))))
        return F.when(x["name"] == "", F.struct(acc.out.alias("out"), verbs.alias("open"))).otherwise(F.struct(grown.alias("out"), F.array().cast("array<string>").alias("open"))).cast(kind)

    first = F.when(head == "", F.array().cast("array<struct<name:string,verbs:array<string>>>")).otherwise(F.array(F.struct(head.alias("name"), F.array().cast("array<string>").alias("verbs"))))
    return F.aggregate(pairs, F.struct(first.alias("out"), F.array().cast("array<string>").alias("open")).cast(kind), step, lambda acc: acc.out)
