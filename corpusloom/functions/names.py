"""Names of people: the form in which they are matched, their words, and the chain of fathers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't identify, and words of relation before a name.
STOP = ("بن", "ابن", "بنت", "ويقال", "يقال", "وهو", "مولي", "مولاهم", "نزيل", "صاحب", "والد", "اخو", "ام", "ثم")
LEADING = ("عن", "عمه", "جده", "اخيه", "خاله", "مولاه", "مولاته", "امه", "جدته", "عمته", "خالته", "ابنه", "زوجه")
#: The words of filiation, the father's by-name in its cases, and what may follow it as a pronoun.
LINKS = ("بن", "ابن")
PRONOUNS = ("ه", "ها", "هم", "هما", "اب", "ا", "اه", "ين", "ي")
_MARKS = "ًٌٍَُِّْٰـ"


def _bare(w: Column) -> Column:
    """A word without its article."""
    return F.when(F.startswith(w, F.lit("ال")) & (F.length(w) > 2), w.substr(F.lit(3), F.length(w))).otherwise(w)


def units(c: Column) -> Column:
    """Words of a name in the form in which names are matched: no marks, letters folded, no article; by-names
    in one case and apart from what follows; a servant's name of two words is one unit."""
    plain = F.translate(F.coalesce(c, F.lit("")), "أإآىة" + _MARKS, "اااي" + "ه")
    w = F.filter(F.split(plain, "[^ء-ي]+"), lambda x: x != "")
    seen = F.transform(w, lambda x, i: F.struct(x.alias("w"), F.get(w, i - 1).alias("left"), F.get(w, i + 1).alias("right")))

    def unit(x: Column) -> Column:
        word, left, right = x["w"], F.coalesce(x["left"], F.lit("")), F.coalesce(x["right"], F.lit(""))
        tail = word.substr(F.lit(4), F.length(word))
        return (
            F.when((word == "ابيه") | (left == "عبد") | ((left == "عبيد") & (word == "الله")), F.array().cast("array<string>"))
            .when((word == "عبد") & (right != ""), F.array(F.concat(F.lit("عبد_"), _bare(right))))
            .when((word == "عبيد") & (right == "الله"), F.array(F.lit("عبيد_الله")))
            .when((word == "ابي") & (right != "بن"), F.array(F.lit("ابو")))
            .when(word == "زكرياء", F.array(F.lit("زكريا")))
            .when(F.startswith(word, F.lit("ابو")) & (tail != "") & ~tail.isin(*PRONOUNS), F.array(F.lit("ابو"), _bare(tail)))
            .otherwise(F.array(_bare(word)))
        )

    return F.flatten(F.transform(seen, unit))


def _identifying(w: Column) -> Column:
    """Words that identify, words of relation at the head left out."""
    w = F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(*STOP))
    first = F.array_position(F.transform(w, lambda x: ~x.isin(*LEADING)), True)
    return F.when(first > 0, F.slice(w, first.cast("int"), F.greatest(F.size(w), F.lit(1)))).otherwise(F.array().cast("array<string>"))


def name_words(c: Column) -> Column:
    """Words of a name that identify, words of relation at its head left out."""
    return _identifying(units(c))


def fathers(c: Column) -> Column:
    """Words of the name linked by "son of" at its head: name, father, grandfather. The head ends at a comma,
    a full stop or the first name that no link follows; a link may be doubled, a by-name's "father of" may
    stand before a father's name."""
    kind = "struct<out:array<string>,wants:boolean,over:boolean>"
    state = lambda out, wants, over: F.struct(out.alias("out"), wants.alias("wants"), over.alias("over")).cast(kind)
    yes, no = F.lit(True), F.lit(False)

    def step(acc, x):
        link = x.isin(*LINKS)
        grown = F.concat(acc["out"], F.array(x))
        return (
            F.when(acc["over"] | (acc["wants"] & link & (F.size(acc["out"]) > 0)), acc)
            .when(acc["wants"], state(grown, (x == "ابو") & (F.size(acc["out"]) > 0), no))
            .otherwise(state(acc["out"], link, ~link))
        )

    return _identifying(F.aggregate(units(F.regexp_extract(F.coalesce(c, F.lit("")), "^[^،.]*", 0)), state(F.array().cast("array<string>"), yes, no), step, lambda acc: acc["out"]))


def short_name(c: Column, parts: int = 2) -> Column:
    """A name up to its parts-th father."""
    one = r"(?:عبد\s+\S+|أبو\s+\S+|أبي\s+\S+|\S+)"
    return F.when(F.trim(c) == "", c).otherwise(F.trim(F.regexp_extract(c, rf"^\s*({one}(?:\s+(?:بن|ابن|بنت)\s+{one}){{0,{parts - 1}}})", 1)))


def distinct_short_names(df, name: str = "name", group: tuple[str, ...] = ()):
    """df with short: two-part names, three parts where a group would hold one twice."""
    from pyspark.sql import Window

    two = short_name(F.col(name), 2)
    n = F.count("*").over(Window.partitionBy(*group, "_two"))
    return df.withColumn("_two", two).withColumn("_n", n).withColumn("short", F.when(F.col("_n") > 1, short_name(F.col(name), 3)).otherwise(F.col("_two"))).drop("_two", "_n")


#: People known by one name, by what their full name begins with; titles that name nobody.
FAMOUS = {
    "محمد بن إسماعيل بن إبراهيم بن المغيرة": "البخاري", "مسلم بن الحجاج": "مسلم", "سليمان بن الأشعث": "أبو داود", "محمد بن عيسى بن سورة": "الترمذي",
    "أحمد بن شعيب بن علي": "النسائي", "محمد بن ماجه": "ابن ماجه", "محمد بن يزيد بن ماجه": "ابن ماجه", "أحمد بن محمد بن حنبل": "أحمد بن حنبل",
    "عبد الله بن أحمد بن محمد بن حنبل": "عبد الله بن أحمد بن حنبل", "سليمان بن أحمد بن أيوب": "الطبراني", "أحمد بن الحسين بن علي بن موسى": "البيهقي",
    "محمد بن عبد الله بن محمد بن حمدويه": "الحاكم النيسابوري", "محمد بن إسحاق بن خزيمة": "ابن خزيمة", "إسماعيل بن إبراهيم بن مقسم": "إسماعيل بن علية",
    "عبد الله بن محمد بن أبي شيبة": "أبو بكر بن أبي شيبة", "محمد بن يعقوب بن يوسف بن معقل": "أبو العباس الأصم",
}
TITLES = (
    "الحافظ", "شيخ الإسلام", "الإمام", "الفقيه", "القاضي", "الوراق", "المقرئ", "الزاهد", "العابد", "الحجة", "الأمين",
    "الشهيد", "الأمير", "الصغير", "الكبير", "الفراء", "النحاس", "الصرام", "الجرب", "مسلم",
)
NAMELESS = "راوٍ غير مسمى"
#: Phrases with which a remark on the bearer begins behind a name.
REMARKS = ("، ويقال", "، قيل", "، وقيل", "، وهو", "، قال", " قال بن", " من السابقين", ":")


def before_remark(c: Column, remarks: tuple[str, ...] = REMARKS) -> Column:
    """A name up to the first remark on its bearer; spaces are single ones, commas close up to the left."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\s*،\s*", "، "), r"\s+", " ")
    at = F.array_min(F.filter(F.array(*[F.locate(r, plain) for r in remarks]), lambda x: x > 0))
    return F.when(at.isNotNull(), F.left(plain, at - 1)).otherwise(plain)


def display_name(name: Column, known_as: Column, famous: dict[str, str] = FAMOUS, titles: tuple[str, ...] = TITLES, nameless: str = NAMELESS) -> Column:
    """The name to show: that of a famous person; else the name up to its third link, with the by-name in
    brackets where it is neither a mere title nor part of it; else the by-name. Null and blank names count as none."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\-.،:]+|[\s\-.،:]+$", "")
    full, by = F.trim(F.coalesce(name, F.lit(""))), strip(known_as)
    plain = strip(before_remark(full))
    rest = r"(?:(?!\s(?:بن|ابن)\s).)*"
    short = F.when(F.size(F.split(plain, " ")) <= 4, plain).otherwise(F.regexp_extract(plain, rf"^({rest}(?:\s(?:بن|ابن)\s{rest}){{0,2}})", 1))
    tells = (by != "") & ~F.forall(F.split(by, r"\s*[،,]\s*"), lambda t: t.isin(*titles, ""))
    own = F.when(short == "", F.when(by != "", by).otherwise(nameless)).when(tells & ~short.contains(by), F.concat(short, F.lit(" ("), by, F.lit(")"))).otherwise(short)
    heads = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in famous.items()])
    hit = F.get(F.filter(heads, lambda h: F.startswith(full, h["k"])), F.lit(0))
    return F.coalesce(hit["v"], own)
