"""Hard-negative mining: scores by a two-dimensional block matrix product (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, split_by_bucket, written
from .vectors import finite, matrix, scaled, width

TIMES, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is between LOW and HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows and anchors of a shard, dimensions of a chunk, anchors of a tile that travels.
ROWS, ANCHORS, CHUNK, TILE = 4096, 256, 32, 64
#: Labels are dealt to so many groups, and shards hold rows of one group.
GROUPS = 64
_I64 = np.iinfo(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices: by doubles where these hold every sum exactly, else modulo 2 ** 64."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """The fewest bytes that hold every number of x, and x so."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return size, x.astype(f"<i{size}")


def best(score: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores among ok, ties by index, best first."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        s = score[at]
        bound = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > bound]
        at = np.r_[above, at[s == bound][: k - len(above)]]
    return at[np.argsort(-score[at].astype(object) if len(at) and score[at].min() == _I64.min else -score[at], kind="stable")]


class Shards:
    """Which shards of rows and of anchors hold each group of labels, and which of them meet."""

    def __init__(self, sizes: list, d: int):
        """sizes: a row (g, n, a, lo, hi) for each group: rows, anchors, least and greatest label."""
        self.d = d
        self.chunks = [slice(a, min(a + CHUNK, d)) for a in range(0, d, CHUNK)]
        self.rows, self.anchors, self.mixed = {}, {}, {s.g for s in sizes if s.lo != s.hi}
        row = anchor = 0
        for s in sizes:
            self.rows[s.g] = range(row, row := row - (-s.n // ROWS))
            self.anchors[s.g] = range(anchor, anchor := anchor - (-s.a // ANCHORS))

    def partners(self, g: int, of_anchors: bool, same: bool) -> list[int]:
        """Shards that a shard of group g meets: those that may hold its label (same), or another one."""
        to = self.rows if of_anchors else self.anchors
        met = [h for h in to if (h == g if same else h != g or h in self.mixed)]
        return [k for h in met for k in to[h]]

    def deal(self, of_anchors: bool, same: bool, extra: np.dtype | None):
        """The function that sends each row's chunks of dimensions to every product they take part in, and
        the head of its records."""
        head = [("rid", "<i8"), ("id", "<i8"), ("label", "<i8"), *([("extra", extra)] if extra is not None else [])]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for g, own in pdf.groupby("g"):
                    mine, met = (self.anchors if of_anchors else self.rows)[g], self.partners(g, of_anchors, same)
                    if not met:
                        continue
                    x = scaled(matrix(own["vector"], self.d), TIMES)
                    rid = own["rid"].to_numpy()
                    shard = mine.start + (rid * 0x9E3779B1 >> 16) % len(mine)
                    for k, part in enumerate(self.chunks):
                        size, values = _narrow(x[:, part])
                        r = np.zeros(len(own), np.dtype([*head, ("x", values.dtype, (values.shape[1],))]))
                        r["rid"], r["id"], r["label"], r["x"] = rid, own["vec_id"], own["label"], values
                        if extra is not None:
                            for at, many in enumerate(own["windows"]):
                                for j, w in enumerate(many):
                                    r["extra"][at, j] = (1, w["positive_id"], w["positive_score"])
                        for s, blob in split_by_bucket(shard, r):
                            out += [(s, other, k, 1, size, blob) if of_anchors else (other, s, k, 0, size, blob) for other in met]
                yield pd.DataFrame(out, columns=["a", "r", "k", "side", "size", "blob"])

        return run, head


class Mining:
    """Shards of the rows and of the anchors, their products tile by tile, and the best of each tile."""

    def __init__(self, vectors: DataFrame, anchor: Column):
        bounded_batches(vectors.sparkSession)
        rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), finite(F.col("embedding")).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
        rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").withColumn("rid", F.monotonically_increasing_id())
        self.rows = written(rows.withColumn("g", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")), "mining-rows")
        sizes = self.rows.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("int")).alias("a"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        self.shards = Shards(sizes.orderBy("g").collect(), width(self.rows))  # GROUPS rows at most

    def tiles(self, anchors: DataFrame, same: bool, extra: np.dtype | None, reduce, schema: str) -> DataFrame:
        """The sums of all chunks' partial products, each tile reduced by reduce(scores, anchors, rows)."""
        shape = "a int, r int, k int, side int, size int, blob binary"
        right, plain = self.shards.deal(False, same, None)
        left, wide = self.shards.deal(True, same, extra)
        chunks = self.shards.chunks
        both = self.rows.select("g", "rid", "vec_id", "label", "vector").mapInPandas(right, shape).union(anchors.mapInPandas(left, shape))

        def gathered(pdf: pd.DataFrame, head: list, k: int) -> tuple[np.ndarray, np.ndarray]:
            n = chunks[k].stop - chunks[k].start
            found = [np.frombuffer(b, np.dtype([*head, ("x", f"<i{s}", (n,))])) for s, b in zip(pdf["size"], pdf["blob"])]
            names = np.concatenate([x[[h[0] for h in head]].astype(np.dtype(head)) for x in found])
            values = np.concatenate([x["x"].astype(np.int64) for x in found])
            order = np.lexsort((names["rid"], names["id"]))
            return names[order], values[order]

        def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            k = int(key[2])
            own = [pdf[pdf["side"] == s] for s in (1, 0)]
            out = []
            if all(len(x) for x in own):
                (na, xa), (nr, xr) = gathered(own[0], wide, k), gathered(own[1], plain, k)
                for at in range(0, len(na), TILE):
                    size, tile = _narrow(product(xa[at : at + TILE], xr))
                    out.append((int(key[0]), int(key[1]), at // TILE, k, size, tile.tobytes(), na[at : at + TILE].tobytes() if k == 0 else None, nr.tobytes() if k == 0 else None))
            return pd.DataFrame(out, columns=["a", "r", "t", "k", "size", "tile", "anchors", "rows"])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf[pdf["k"] == 0].iloc[0]
            names = np.frombuffer(first["anchors"], np.dtype(wide)), np.frombuffer(first["rows"], np.dtype(plain))
            total = np.zeros((len(names[0]), len(names[1])), np.int64)
            for size, tile in zip(pdf["size"], pdf["tile"]):
                total += np.frombuffer(tile, f"<i{size}").reshape(total.shape)
            return reduce(total, *names)

        partial = both.groupBy("a", "r", "k").applyInPandas(multiply, "a int, r int, t int, k int, size int, tile binary, anchors binary, rows binary")
        return partial.groupBy("a", "r", "t").applyInPandas(add, schema)

    def positives(self) -> DataFrame:
        """rid, anchor_id, positive_id, positive_score: the best rows of each anchor's label but itself."""

        def reduce(score: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
            out = []
            for k, a in enumerate(anchors):
                for j in best(score[k], (rows["label"] == a["label"]) & (rows["rid"] != a["rid"]), POSITIVES):
                    out.append((a["rid"], a["id"], rows["id"][j], rows["rid"][j], score[k, j]))
            return pd.DataFrame(out, columns=["rid", "anchor_id", "positive_id", "other", "positive_score"])

        found = self.tiles(self.rows.where("anchor").select("g", "rid", "vec_id", "label", "vector"), True, None, reduce, "rid long, anchor_id long, positive_id long, other long, positive_score long")
        order = W.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id", "other")
        return found.withColumn("i", F.row_number().over(order)).where(F.col("i") <= POSITIVES)

    def negatives(self, positives: DataFrame) -> DataFrame:
        """The rows of other labels within each positive's window, best first."""
        windows = positives.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("i", "positive_id", "positive_score"))).alias("windows"))
        anchors = self.rows.where("anchor").select("g", "rid", "vec_id", "label", "vector").join(windows, "rid")
        extra = np.dtype(([("has", "<i8"), ("id", "<i8"), ("score", "<i8")], (POSITIVES,)))

        def reduce(score: np.ndarray, anchors: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
            out = []
            for k, a in enumerate(anchors):
                other = rows["label"] != a["label"]
                for i, (has, positive, p) in enumerate(a["extra"].tolist()):
                    lo, hi = -(-LOW * p // 100), HIGH * p // 100  # whole numbers between the two bounds
                    if has and lo <= hi:
                        for j in best(score[k], other & (score[k] >= lo) & (score[k] <= hi), NEGATIVES):
                            out.append((a["rid"], i, a["id"], positive, rows["id"][j], rows["rid"][j], p, score[k, j]))
            return pd.DataFrame(out, columns=["rid", "i", "anchor_id", "positive_id", "negative_id", "other", "positive_score", "negative_score"])

        found = self.tiles(anchors, False, extra, reduce, "rid long, i int, anchor_id long, positive_id long, negative_id long, other long, positive_score long, negative_score long")
        order = W.partitionBy("rid", "i").orderBy(F.desc("negative_score"), "negative_id", "other")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
        return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over the rows of
    vectors(vec_id, label, embedding); anchor says of a row whether it is one.

    A component x counts as floor(256 * x), a score is the inner product in longs (it wraps beyond them;
    components beyond 2 ** 62 count as that), higher is better and the smaller vec_id wins ties. Positives
    are the best other rows of the anchor's label, negatives the best of other labels whose score is within
    the positive's window. Rows with a null id, label or vector, or a null or non-finite entry, take no
    part; shorter vectors count as filled up with zeros; repeated rows are rows of their own; an empty table
    or one without anchors gives no rows; other columns are never read."""
    mining = Mining(vectors, anchor)
    return mining.negatives(written(mining.positives(), "mining-positives"))
