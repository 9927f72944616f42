"""Judged pages: the reply cases, chunks, answers known before, and what becomes of a request."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import replies
from corpusloom.operators import judging

MATN = "انما الاعمال بالنيات وانما لكل امرئ ما نوى"
GOOD = "انما الأعمال بالنيات"


def of(spark, raw, rows=3):
    r = spark.createDataFrame([("q", i, 10 * i, MATN) for i in range(1, rows + 1)], "request_id string, place int, id long, matn string")
    got = replies.judged(spark.createDataFrame([("q", raw)], "request_id string, raw string"), r)
    return {x.place: (x.level, x.quote, x.reason) for x in got.collect()}


def answer(index, level="direct", quote=GOOD, reason="r", **more):
    return {"Index": index, "Level": level, "Quote": quote, "Reason": reason} | more


NONE = (None, None, None)
OK = ("direct", GOOD, "r")


def test_reply_cases(spark):
    say = lambda *a: json.dumps(a, ensure_ascii=False)
    assert of(spark, say(answer(1), answer(2, "PARTIAL "))) == {1: OK, 2: ("partial", GOOD, "r"), 3: NONE}  # one is missing
    assert of(spark, say(answer(1), answer(1, "partial"), answer(2))) == {1: NONE, 2: OK, 3: NONE}  # repeated
    assert of(spark, say(answer(0), answer(4), answer(-1), answer(2))) == {1: NONE, 2: OK, 3: NONE}  # out of range
    assert of(spark, say(answer(1, quote="انما الاعمال"), answer(2))) == {1: NONE, 2: OK, 3: NONE}  # short quote
    assert of(spark, say(answer(1, quote="كلام ليس في النص"), answer(2, "great"), answer(3, quote=None))) == {1: NONE, 2: NONE, 3: NONE}  # absent quote, unknown level
    assert of(spark, "```json\n" + say(answer(1)) + "\n```") == {1: OK, 2: NONE, 3: NONE}  # fences
    assert of(spark, "Here you are: " + say(answer(3)) + " That is all.") == {1: NONE, 2: NONE, 3: OK}  # surrounding text
    low = {k.lower(): v for k, v in answer(1).items()}
    assert of(spark, say(low, {"INDEX": 2, "level": "direct", "Quote": " " + GOOD + " ", "other": [1]})) == {1: OK, 2: ("direct", GOOD, ""), 3: NONE}
    assert of(spark, None) == of(spark, "no list") == of(spark, "[{]") == {1: NONE, 2: NONE, 3: NONE}


def test_pages(spark):
    texts = spark.createDataFrame([(i, MATN, MATN) for i in range(1, 100)], "id long, matn string, norm string")
    requests = spark.createDataFrame(
        [("a", "الاعمال بالنيات", [*range(1, 46), 1, 2]), ("b", "", [1]), ("c", "الاعمال", []), ("d", "الاعمال", [1, 2, 999]), ("e", "الاعمال", [3]), ("f", "الاعمال", [4]), ("g", "الاعمال", list(range(1, 80)))],
        "request_id string, query string, ids array<long>",
    )
    known = spark.createDataFrame([("الاعمال بالنيات", 5, "partial", "q", "r"), ("الاعمال", 2, "direct", "q", "r"), ("الاعمال", 5, "direct", "q", "r")], "query_key string, id long, level string, quote string, reason string")
    seen = []

    def judge(prompts):
        seen.extend(prompts.collect())
        n = F.size(F.split("lines", "\n"))
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string('{"Index": %d, "Level": "direct", "Quote": "' + GOOD + '", "Reason": ""}', i))
        raw = F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))
        late = (F.col("request_id") == "e") | ((F.col("request_id") == "a") & (F.col("chunk") == 1))
        return prompts.withColumn("failure", F.when(late, "timeout")).withColumn("raw", F.when(F.col("request_id") == "f", "nothing to read").when(~late, raw))

    items, status, fresh = judging.judge_pages(requests, texts, known, judge)
    assert {r.request_id: (r.status, r.chunks, r.failed) for r in status.collect()} == {
        "a": ("partial", 3, 1), "b": ("invalid", 0, 0), "c": ("invalid", 0, 0), "d": ("reviewed", 1, 0), "e": ("timeout", 1, 1), "f": ("unavailable", 1, 1), "g": ("reviewed", 3, 0),
    }
    assert sorted((p.request_id, p.chunk, p.lines.count("\n") + 1) for p in seen) == [("a", 0, 20), ("a", 1, 20), ("a", 2, 4), ("d", 0, 1), ("e", 0, 1), ("f", 0, 1), ("g", 0, 20), ("g", 1, 20), ("g", 2, 8)]
    got = {(r.request_id, r.place): (r.id, r.level, r.cached) for r in items.collect()}
    assert len([1 for k in got if k[0] == "a"]) == 45 and len([1 for k in got if k[0] == "g"]) == 50
    assert got["a", 5] == (5, "partial", True) and got["a", 1] == (1, "direct", False) and got["a", 30] == (30, None, False)
    assert [got["d", k] for k in (1, 2, 3)] == [(1, "direct", False), (2, "direct", True), (999, None, False)] and got["f", 1] == (4, None, False)
    keys = {(r.query_key, r.id) for r in fresh.collect()}
    assert ("الاعمال", 1) in keys and ("الاعمال", 2) not in keys and len(keys) == 24 + 48
    assert judging.kept(known, fresh).count() == 3 + len(keys) and judging.kept(known, fresh, 2).count() == len(keys)
    again, status, _ = judging.judge_pages(requests.where("request_id = 'd'"), texts, judging.kept(known, fresh), judge)
    assert [r.cached for r in again.orderBy("place").collect()] == [True, True, False] and status.first().chunks == 0


def test_windows(spark):
    df = spark.createDataFrame([("a" * 100 + " bc " + "d" * 500, 100), ("short", 3)], "m string, at int")
    assert [r[0] for r in df.select(judging.shown(df.m, df["at"])).collect()] == ["… " + "a" * 80 + " bc " + "d" * 266 + " …", "short"]
