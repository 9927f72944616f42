"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .hashing import mix, word_hashes

#: Hashed features; the weights that survive L1 are at most so many, which bounds the broadcast.
BITS = 20
#: Labelled rows that the model is fitted on, at most (those with the smallest hashes of their ids).
FIT_ROWS = 15_000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 1.0, 1.0, 2.0, 0.0
THRESHOLD = 0.3
HELD_OUT_REST = 2

_PUNCTUATION = bytes(32 if chr(c) in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def _clean(texts) -> list[bytes]:
    """Lower-case UTF-8 with ASCII punctuation (but - and ') as spaces."""
    return [t.lower().encode().translate(_PUNCTUATION) if isinstance(t, str) else b"" for t in texts]


def _grams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word, pair of neighbours and pair with one word between; at: where
    the words of each document start and end."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    docs, features = [doc], [h]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            inside = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][inside])
            features.append(mix(h[:-gap][inside] * np.uint64(3) + h[gap:][inside] + np.uint64(salt)))
    return np.concatenate(docs), (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.uint32)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed distinct features of each text."""
    for pdf in batches:
        packed = []
        for _, h, at in word_hashes(_clean(pdf["text"])):
            doc, feature = _grams(h, at)
            order = np.unique(doc.astype(np.uint64) << np.uint64(32) | feature)
            cut = np.searchsorted(order >> np.uint64(32), np.arange(len(at)))
            low = order.astype(np.uint32)
            packed += [low[cut[k] : cut[k + 1]].tobytes() for k in range(len(at) - 1)]
        yield pd.DataFrame({"h": pdf["h"], "y": pdf["y"], "x": packed})


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. Per-coordinate rates come from the summed squared gradients n; a coordinate
    whose |z| stays within L1 has weight 0. The bias isn't shrunk."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(examples))
        for k in order:
            x, y = examples[k]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            wb = -zb * ALPHA / (BETA + np.sqrt(nb))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            g2 = g * g
            z[x] = zx + g - (np.sqrt(nx + g2) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g2
            zb += g - (np.sqrt(nb + g2) - np.sqrt(nb)) / ALPHA * wb
            nb += g2
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, float(-zb * ALPHA / (BETA + np.sqrt(nb)))


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = sorted((h, y, x) for pdf in batches for h, y, x in zip(pdf["h"], pdf["y"], pdf["x"]))
    if rows:
        w, bias = ftrl([(np.frombuffer(x, np.uint32), y) for _, y, x in rows])
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"f": np.r_[-1, kept], "w": np.r_[bias, w[kept]]})


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT_REST


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[int, float]]:
    """Sparse weights as (feature, weight), the bias as feature -1. Fitted on at most fit_rows labelled
    rows outside the held-out fold; rows without id or label are left out; no labels, no weights."""
    bounded_batches(docs.sparkSession)
    few = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
        .orderBy("h", "doc_id", "y").limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("h", "y", "text")
    packed = rows.mapInPandas(_features, "h long, y int, x binary")
    return [(r.f, r.w) for r in packed.repartition(1).mapInPandas(_fit, "f long, w double").collect()]


def score(docs: DataFrame, weights: list[tuple[int, float]], cols: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """cols of every row of docs, then score and predicted. A feature counts once a text. Only text is
    read for the score; null and empty texts get the bias alone; without weights every score is 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((np.array([f for f, _ in weights], np.int64), np.array([w for _, w in weights])))
    src = docs.select(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(cols)], *([] if "text" in cols else [F.col("text").alias("t")]))
    text = f"c{cols.index('text')}" if "text" in cols else "t"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, v = sent.value
        dense, bias = np.zeros(1 << BITS), float(v[f < 0].sum()) if len(f) else -np.inf
        dense[f[f >= 0]] = v[f >= 0]
        for pdf in batches:
            total = np.full(len(pdf), bias)
            for first, h, at in word_hashes(_clean(pdf[text])):
                doc, feature = _grams(h, at)
                hit = dense[feature] != 0
                pair = np.unique(doc[hit].astype(np.uint64) << np.uint64(32) | feature[hit])
                np.add.at(total, first + (pair >> np.uint64(32)).astype(np.int64), dense[pair.astype(np.uint32)])
            out = pdf[[f"c{k}" for k in range(len(cols))]].copy()
            out["s"] = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if len(f) else 0.0
            yield out

    scored = src.mapInPandas(run, ", ".join(f"c{k} string" for k in range(len(cols))) + ", s double")
    return scored.select(*[F.col(f"c{k}").cast(docs.schema[c].dataType).alias(c) for k, c in enumerate(cols)], F.col("s").alias("score"), (F.col("s") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs: repeated rows score alike, null ids are
    not held out, other columns (whatever their names) are never read, an empty table gives no rows."""
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
