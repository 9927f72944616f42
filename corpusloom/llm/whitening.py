"""Embedding whitening: Welford updates in every partition, merged in a tree, symmetric QR (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, written
from .eigen import symmetric_qr
from .vectors import finite, matrix, scaled, width

#: An entry c becomes floor(TIMES * c) + SHIFT.
TIMES, SHIFT = 64, 1_000_000
#: Components that are returned, and partial moments that one task merges.
COMPONENTS, FAN = 32, 16
#: A component whose eigenvalue isn't above this part of the largest one has no variance.
FLAT = 1e-12

_PARTIAL = "part long, n long, sums array<string>, mean array<double>, m2 array<double>"


class Moments:
    """Count, exact sums, mean and centred second moments of rows seen so far."""

    def __init__(self, d: int, n: int = 0, sums=None, mean=None, m2=None):
        self.n, self.sums = n, [0] * d if sums is None else [int(x) for x in sums]
        self.mean = np.zeros(d) if mean is None else np.array(mean, float)
        self.m2 = np.zeros((d, d)) if m2 is None else np.array(m2, float).reshape(d, d)

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, a rank-one term for each row."""
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            self.m2 += np.outer(before, x - self.mean)

    def count(self, x: np.ndarray) -> None:
        """Exact sums of whole numbers, by halves so that no batch overflows."""
        low = x & 0xFFFFFFFF
        self.sums = [s + (int(h) << 32) + int(l) for s, h, l in zip(self.sums, (x >> 32).sum(axis=0), low.sum(axis=0))]

    def merge(self, other: Moments) -> None:
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.m2 += other.m2 + np.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
            self.sums = [a + b for a, b in zip(self.sums, other.sums)]
            self.n = n

    def covariance(self) -> np.ndarray:
        v = self.m2 / max(1, self.n)
        return (v + v.T) / 2

    def row(self, part: int) -> tuple:
        return part, self.n, [str(x) for x in self.sums], self.mean.tolist(), self.m2.ravel().tolist()


def _partials(rows, d: int):
    """rows turns a batch into (values, whole numbers or None); a row of moments for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Moments(d)
        for pdf in batches:
            if len(pdf):
                values, whole = rows(pdf)
                own.add(values)
                if whole is not None:
                    own.count(whole)
        if own.n:
            yield pd.DataFrame([own.row(TaskContext.get().partitionId())], columns=["part", "n", "sums", "mean", "m2"])

    return run


def _merged(d: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Moments(d)
        for r in pdf.sort_values("part").itertuples(index=False):
            own.merge(Moments(d, r.n, r.sums, r.mean, r.m2))
        return pd.DataFrame([own.row(int(key[0]))], columns=["part", "n", "sums", "mean", "m2"])

    return run


def moments(vectors: DataFrame, rows, d: int) -> Moments:
    """The moments of all rows. Partials meet FAN at a time until one is left, so neither a task nor the
    driver holds more than FAN matrices of d * d numbers."""
    parts = written(vectors.mapInPandas(_partials(rows, d), _PARTIAL), "moments")
    while (left := parts.count()) > 1:
        fewer = written(parts.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInPandas(_merged(d), _PARTIAL), "moments")
        drop_written(parts)
        parts = fewer
    found = parts.first() if left else None
    drop_written(parts)
    return Moments(d) if found is None else Moments(d, found.n, found.sums, found.mean, found.m2)


def _whole(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return scaled(matrix(pdf["vector"], d), TIMES) + SHIFT


class Whitening:
    """Fitted on all vectors of a table: n, exact sums, eigenvalues and eigenvectors of the covariance."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS):
        self.d = d = width(vectors)

        def rows(pdf: pd.DataFrame):
            x = _whole(pdf, d)
            return x.astype(float), x

        fit = moments(vectors, rows, d)
        self.n, self.sums = fit.n, fit.sums
        values, vectors_ = symmetric_qr(fit.covariance())
        self.trace = float(np.trace(fit.covariance()))
        self.values, self.vectors = values[:components], vectors_[:, :components]
        self.sound = self.values > FLAT * max(values[0], 0.0) if self.trace > 0 else np.zeros(len(self.values), bool)

    def centred(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Of whole-number rows: the exact sums of (n * x - S) ** 2, and x - S / n."""
        n, most = self.n, max([abs(s) for s in self.sums], default=0)
        if n * int(np.abs(x).max(initial=0)) + most < 1 << 62:
            t = n * x - np.array(self.sums, np.int64)
            if self.d * int(np.abs(t).max(initial=0)) ** 2 < 1 << 63:
                return (t * t).sum(axis=1).tolist(), t / n
        else:
            t = n * x.astype(object) - np.array(self.sums, object)
        t = t.astype(object)
        sums = [int(s) for s in (t * t).sum(axis=1)]
        return [s if s < 1 << 63 else None for s in sums], (t / n).astype(float)

    def __call__(self, pdf: pd.DataFrame) -> tuple[list[int | None], np.ndarray]:
        deviation, y = self.centred(_whole(pdf, self.d))
        root = np.sqrt(np.where(self.sound, self.values, 1.0))
        return deviation, np.where(self.sound, y @ self.vectors / root, 0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every row of
    vectors(vec_id, embedding) whose vector is neither null nor holds a null or non-finite entry, and
    each component up to the number asked for (fewer dimensions give fewer).

    Shorter vectors count as filled up with zeros, an empty one as zeros. Repeated rows and null ids take
    part and give rows. A component without variance has whitened 0 and stays out of identity_error; a
    deviation beyond a long is null; an empty table gives no rows; other columns are never read."""
    bounded_batches(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType
    rows = vectors.select(F.col("vec_id").cast("string").alias("id"), finite(F.col("embedding")).alias("vector")).where("vector IS NOT NULL")
    fit = Whitening(rows.select("vector"), components)
    k = len(fit.values)
    check = moments(rows.select("vector"), lambda pdf: (fit(pdf)[1], None), k)
    apart = np.abs(check.covariance() - np.eye(k))[np.ix_(fit.sound, fit.sound)]
    error = float(apart.max(initial=0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                deviation, w = fit(pdf)
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "deviation": [None if x is None else str(x) for x in deviation], "w": w.tolist()})

    explained = F.array(*[F.lit(float(e) / fit.trace if fit.trace > 0 else 0.0) for e in fit.values])
    out = rows.mapInPandas(run, "id string, deviation string, w array<double>").select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").cast(kind).alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
