"""Embedding near-dedup: an exact range join over pivots' cells (operator 13)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, split_by_bucket, written
from .components import components
from .vectors import finite, matrix, width

COSINE = 0.9
#: Vectors of a cell and of a block of a cell, about; a task holds two blocks.
CELL, BLOCK = 4096, 4096
#: Pivots at most, and the distinct vectors they are chosen from (those whose key has the least hash).
#: Both bound what is sent to every task; neither changes which pairs are found.
PIVOTS, SAMPLE = 1024, 4096
#: Bounds on distances give way by so much: rounding moves a distance near 0 by some 1e-8.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. Scaled by their largest entry first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(x: np.ndarray, most: int, half: float) -> np.ndarray:
    """Up to most unit vectors, none within the angle half of another: each the mean of the rows around
    the first row that no earlier one has near."""
    out: list[np.ndarray] = []
    free = np.ones(len(x), bool)
    for k in range(len(x)):
        if len(out) == most:
            break
        if free[k]:
            near = x[x @ x[k] >= math.cos(half)]
            mean = near.mean(axis=0)
            p = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 0.5 else x[k]
            out.append(p)
            free &= x @ p < math.cos(half)
            free &= x @ x[k] < math.cos(half)
    return np.array(out)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ pivots.T)))


class Plan:
    """Pivots, and what the rows of each cell say about it: sizes, and the range of distances."""

    def __init__(self, pivots: np.ndarray, d: int, cosine: float, kind: str):
        self.pivots, self.d, self.cosine = pivots, d, cosine
        self.eps, self.half = math.sqrt(2 - 2 * cosine), math.acos(cosine) / 2
        self.record = np.dtype([("node", "<i8"), ("m", "<i8"), ("side", "u1"), ("v", kind, (d,))])

    def cells(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector's nearest pivot; core says that it is so near that all such link with each other."""
        near = 2 * math.sin(self.half / 2) - SLACK
        for pdf in batches:
            if len(pdf):
                v = matrix(pdf["vector"], self.d)
                far = _distances(unit(v), self.pivots)
                cell = far.argmin(axis=1)
                own = far[np.arange(len(v)), cell]
                raw = v.astype(self.record["v"].base)
                yield pd.DataFrame({"node": pdf["node"], "m": pdf["m"], "cell": cell, "core": own < near, "far": own, "raw": [r.tobytes() for r in raw]})

    def settle(self, stats: list) -> None:
        """stats: a row (cell, core, n, lo, hi) for each kind of part of a cell."""
        self.cell = np.array([s.cell for s in stats])
        self.core = np.array([s.core for s in stats])
        self.lo, self.hi = np.array([s.lo for s in stats]), np.array([s.hi for s in stats])
        self.parts = np.array([-(-s.n // BLOCK) for s in stats])
        self.first = np.r_[0, np.cumsum(self.parts)]
        self.at = {(s.cell, s.core): k for k, s in enumerate(stats)}
        apart = _distances(self.pivots, self.pivots)
        self.apart = np.maximum(apart, SLACK)

    def reachable(self, far: np.ndarray, cell: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which kinds of parts may hold a vector within eps, by the triangle inequality on the distance to
        their pivot and on the hyperplane halfway between the two pivots."""
        to = far[:, self.cell]
        ball = (to <= self.hi + self.eps + SLACK) & (to >= self.lo - self.eps - SLACK)
        own = far[np.arange(len(far)), cell][:, None]
        plane = (to * to - own * own) / (2 * self.apart[cell][:, self.cell]) <= self.eps + SLACK
        plane |= self.cell == cell[:, None]
        done = (self.cell == cell[:, None]) & self.core & self.core[kind][:, None]  # core with core needs no comparison
        return ball & plane & ~done

    def replicas(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records of every vector for each pair of blocks in which it may have a partner."""
        blocks = int(self.first[-1])
        for pdf in (x.iloc[at : at + 512] for x in batches for at in range(0, len(x), 512)):
            v = np.frombuffer(b"".join(pdf["raw"]), self.record["v"].base).reshape(-1, self.d)
            cell = pdf["cell"].to_numpy()
            kind = np.array([self.at[c, k] for c, k in zip(cell.tolist(), pdf["core"].tolist())])
            node = pdf["node"].to_numpy()
            own = self.first[kind] + (node.view(np.uint64) % self.parts[kind].astype(np.uint64)).astype(np.int64)
            row, to = np.nonzero(self.reachable(_distances(unit(v.astype(float)), self.pivots), cell, kind))
            many = self.parts[to]
            row = np.repeat(row, many)
            other = np.repeat(self.first[to], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            step = max(1, (8 << 20) // self.record.itemsize)
            for a in range(0, len(row), step):
                r, o = row[a : a + step], other[a : a + step]
                records = np.empty(len(r), self.record)
                records["node"], records["m"], records["v"] = node[r], pdf["m"].to_numpy()[r], v[r]
                records["side"] = own[r] > o
                pair = np.minimum(own[r], o) * blocks + np.maximum(own[r], o)
                yield pd.DataFrame(list(split_by_bucket(pair, records)), columns=["pair", "blob"])

    def join(self, key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a pair of blocks: each vector that links, its links (copies counted), and a vector of its
        component among those that are here."""
        r = np.frombuffer(b"".join(pdf["blob"]), self.record)
        r = r[np.argsort(r["side"], kind="stable")]
        na = int((r["side"] == 0).sum())
        alone = divmod(int(key[0]), int(self.first[-1]))
        a, b = (slice(0, na), slice(0, na)) if alone[0] == alone[1] else (slice(0, na), slice(na, len(r)))
        links, root = np.zeros(len(r), np.int64), np.arange(len(r))
        u = unit(r["v"].astype(float)) if len(r) else np.zeros((0, self.d))
        same = a == b
        for at in range(a.start, a.stop, 256):
            rows = slice(at, min(at + 256, a.stop))
            start = at if same else b.start  # below the diagonal all is known
            s = u[rows] @ u[start : b.stop].T
            i, j = np.nonzero(s >= self.cosine - 1e-12)
            if not len(i):
                continue
            close = np.flatnonzero(s[i, j] < self.cosine + 1e-12)
            i, j = i + at, j + start
            drop = np.zeros(len(i), bool)
            for k in close:
                drop[k] = cosine(r["v"][i[k]], r["v"][j[k]]) < self.cosine
            keep = ~drop & ((i < j) if same else True)
            i, j = i[keep], j[keep]
            np.add.at(links, i, r["m"][j])
            np.add.at(links, j, r["m"][i])
            _unite(root, i, j)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": r["node"][hit], "links": links[hit], "root": r["node"][root[hit]]})


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x.astype(float), y.astype(float)
    if not all(1e-100 < np.abs(v).max() < 1e100 for v in (x, y)):
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y) / (math.sqrt(float(x @ x)) * math.sqrt(float(y @ y)))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of root along the pairs (i, j); every entry then names its set's first member."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


class MetricJoin:
    """Links between the distinct vectors of a table, by cosine."""

    def __init__(self, vectors: DataFrame, cosine: float = COSINE):
        spark = self.spark = vectors.sparkSession
        bounded_batches(spark)
        kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
        v = finite(F.col("embedding"))
        v = F.when(F.exists(v, lambda x: x != 0), v)
        keyed = vectors.select("vec_id", v.alias("vector"))
        #: Every row, k1 null where its vector links with nothing.
        self.rows = keyed.select("vec_id", *[F.when(F.col("vector").isNotNull(), h).alias(k) for k, h in (("k1", F.xxhash64("vector")), ("k2", F.xxhash64(F.lit(0x5EED), "vector")))], "vector")
        one = self.rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
        # a hash of 8 bytes is a bijection: numbers stay distinct, and have no order for components() to follow
        self.classes = written(one.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "metric-classes")
        n = self.classes.count()
        self.plan = None
        if n:
            d = width(self.classes)
            sample = matrix([r.vector for r in self.classes.orderBy(F.xxhash64("k1"), "k2").limit(SAMPLE).select("vector").collect()], d)
            half = math.acos(cosine) / 2
            self.plan = Plan(choose_pivots(unit(sample), min(PIVOTS, -(-n // CELL)), half), d, cosine, kind)

    def links(self) -> DataFrame:
        """(node, links, root) rows: partial counts of the vectors linked with a node, and a node of its
        component. Copies of one vector are one node."""
        plan = self.plan
        near = written(self.classes.select("node", "m", "vector").mapInPandas(plan.cells, "node long, m long, cell int, core boolean, far double, raw binary"), "metric-cells")
        stats = near.groupBy("cell", "core").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi"), F.sum("m").alias("all"), F.min("node").alias("root"))
        stats = stats.collect()  # two rows a pivot at most
        plan.settle(stats)
        pairs = near.mapInPandas(plan.replicas, "pair long, blob binary")
        found = pairs.groupBy("pair").applyInPandas(lambda key, pdf: plan.join(key, pdf), "node long, links long, root long")
        core = [(s.cell, s.all, s.root) for s in stats if s.core]
        if core:
            table = F.broadcast(self.spark.createDataFrame(core, "cell int, all long, root long"))
            found = found.union(near.where("core").join(table, "cell").select("node", (F.col("all") - F.col("m")).alias("links"), "root"))
        return written(found, "metric-links")

    def settled(self) -> DataFrame:
        """(k1, k2, n_links, component_id) of every distinct vector."""
        own = self.classes.select("k1", "k2", "node", "m", "least")
        if self.plan is None:
            return own.select("k1", "k2", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
        found = self.links()
        count = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        own = own.join(count, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = written(own, "metric-roots")
        best = own.groupBy("root").agg(F.min("least").alias("component_id"))
        return own.join(best, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding).

    Every pair of rows whose cosine in doubles is at least the bound links, and no other. Vectors that are
    null, zero or hold a null or a non-finite entry link with nothing; a shorter vector counts as filled up
    with zeros. Rows of one vector (named by 128 bits) are one class, linked with each other. component_id
    is the smallest vec_id that links reach; a null id is none unless its whole component has no other, and
    only then is such a row kept. Repeated rows give a row each; an empty table gives none; other columns
    are never read."""
    join = MetricJoin(vectors, cosine)
    settled = written(join.settled(), "metric-settled")
    rows = join.rows.select("vec_id", "k1", "k2").join(settled.hint("merge"), ["k1", "k2"], "left")
    own = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
