from pyspark.sql import functions as F

from corpusloom.functions import names
from corpusloom.operators import compare


def test_names(spark):
    r = spark.range(1).select(
        names.name_words(F.lit("عن أبي مسلم الخولاني")).alias("a"), names.fathers(F.lit("محمد بن عبد الله بن سعد القرشي")).alias("b"), names.short_name(F.lit("زيد بن عمر بن سعد البصري"), 2).alias("c"),
    ).first()
    assert r.a == ["ابو", "مسلم", "خولاني"] and r.b[:2] == ["محمد", "عبد_له"] and r.c == "زيد بن عمر"
    df = spark.createDataFrame([("زيد بن عمر بن سعد",), ("زيد بن عمر بن علي",), ("بكر بن علي",)], "name string")
    assert {x.short for x in names.distinct_short_names(df).collect()} == {"زيد بن عمر بن سعد", "زيد بن عمر بن علي", "بكر بن علي"}


def test_verification_metrics(spark):
    cases = spark.createDataFrame([("a", "exact", "exact", 10.0), ("a", "not-found", "variant", 20.0), ("b", "variant", "not-found", 30.0)], "grp string, expected string, got string, ms double")
    got = {r.grp: tuple(r)[1:] for r in compare.verification_metrics(cases).collect()}
    assert got[None] == (3, 1, 1, 1, 20.0) and got["a"] == (2, 1, 1, 0, 15.0)


def test_segments(spark):
    from corpusloom.functions.isnad import segments

    text = "حَدَّثَنَا الإمام زيد بن عمر (١)، قال: حدثنا بكر رضي الله عنه، عن سعد، بن علي، عن رسول الله قال شيئا"
    got = spark.range(1).select(segments(F.lit(text)).alias("s"), segments(F.lit(None).cast("string")).alias("n")).first()
    assert [(x.name, x.verbs) for x in got.s] == [("زيد بن عمر", ["قال", "حدثنا"]), ("بكر", ["عن"]), ("سعد، بن علي", [])] and got.n == []


def test_display_name(spark):
    rows = [
        ("محمد بن عيسى بن سورة الضرير", None, "الترمذي"),
        ("زيد بن عمر بن سعد بن علي البصري", "الأعور", "زيد بن عمر بن سعد (الأعور)"),
        ("زيد بن عمر بن سعد بن علي", "الحافظ ، الإمام", "زيد بن عمر بن سعد"),
        ("زيد بن عمر، ويقال: ابن علي", "- .", "زيد بن عمر"),
        ("زيد الأعور بن عمر بن سعد", "الأعور", "زيد الأعور بن عمر بن سعد"),
        ("  ", "الأعمش", "الأعمش"), (None, None, names.NAMELESS),
    ]
    df = spark.createDataFrame(rows, "name string, by string, want string")
    assert [(r.got, r.want) for r in df.select(names.display_name(F.col("name"), F.col("by")).alias("got"), "want").collect() if r.got != r.want] == []
