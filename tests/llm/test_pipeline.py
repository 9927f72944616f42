"""The pipeline's stages, one by one, against their brute forces."""

import random

from test_native import WORD, docs
from test_text_operators import brute_components, near_copies

import corpus_pipeline as cp
from corpusloom.llm.common import written


def test_stages(spark, tmp_path):
    random.seed(9)
    clean = [" ".join(random.choice(["sea", "hill", "the", "green", f"n{random.randrange(400)}"]) for _ in range(40)) for _ in range(400)]
    toxic = [c + " zonk blarg zonk" for c in clean[:60]]
    passage = " ".join(f"p{k}" for k in range(120))
    texts = clean + toxic + near_copies() + [c + " " + passage + " " + c for c in clean[-3:]] + [None, ""]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(texts)]
    d = docs(spark, rows)
    spark.createDataFrame([(i, 1, int("zonk" in (t or ""))) for i, t, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "suffix_dedup", "mixing", "bpe"]
    out = {}
    for name, stage in cp.STAGES:
        d = written(stage(spark, d, str(tmp_path)), name)
        out[name] = d.collect()
        assert name == "bpe" or d.columns == cp.COLUMNS
    kept = {r.doc_id for r in out["toxicity"]}
    assert kept == {i for i, t, _ in rows if "zonk" not in (t or "")}
    left = [(i, t, s) for i, t, s in rows if i in kept]
    assert {r.doc_id for r in out["near_duplicates"]} == {c for _, _, c in brute_components(left)}
    after = {r.doc_id: r.text for r in out["suffix_dedup"]}
    assert set(after) == {r.doc_id for r in out["near_duplicates"]}
    assert not any(passage[50:450] in (t or "") for t in after.values())
    assert all(r.n_chars == len(r.text) for r in out["suffix_dedup"])
    size = sum(len(WORD.findall(t)) for t in after.values())
    mixed = sum(len(WORD.findall(r.text)) for r in out["mixing"])
    assert abs(mixed - size) < 600 and {r.doc_id for r in out["mixing"]} <= set(after)
    assert len(out["bpe"]) == len(out["mixing"])


def test_stages_on_hostile_and_empty_tables(spark, tmp_path):
    """Null ids, null, empty and blank texts, ties, repeated rows, a very long text, columns of other names."""
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = " ".join(f"w{k % 9973}x{k % 89}" for k in range(150_000))
    rows = [(None, "a b c", "en", "s"), (None, None, None, None), (3, "", "en", "s"), (4, " \n", "en", None), (5, "same words here", "en", "s"), (5, "same words here", "en", "s"), (6, "same words here", "en", "s"), (7, long, "en", "t"), (1, "plain", "en", "t")]
    d = spark.createDataFrame([(i, t, x, s, len(t or ""), "k", 1, "row") for i, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long, k string, s int, row string")
    kept = []
    for name, stage in cp.STAGES:
        d = written(stage(spark, d, str(tmp_path)), name)
        kept.append(d.collect())
        assert name == "bpe" or d.columns == cp.COLUMNS
    assert len(kept[0]) == len(rows)  # without a weight for "toxic" all stay
    near = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept[1])
    assert [r[:2] for r in near] == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 7), (True, 0), (True, 0)]
    assert {r.doc_id: r.text for r in kept[2] if r.doc_id == 7} == {7: long}
    assert {r.text for r in kept[3]} <= {r.text for r in kept[2]} and all(r.text.split() for r in kept[3]) and len(kept[4]) == len(kept[3])
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
