"""Eigenvalues and eigenvectors of a symmetric matrix: Householder reflections, then implicit QR steps."""

from __future__ import annotations

import math

import numpy as np

_EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, q): q.T @ a @ q has d on its diagonal and e beside it."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        to = -math.copysign(length, x[0])
        x[0] -= to
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = p - x * (x @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = to
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, by QR steps with
    Wilkinson's shift on its tridiagonal form."""
    scale = float(np.abs(v).max(initial=0)) or 1.0
    d, e, q = tridiagonal(v / scale)
    q = np.ascontiguousarray(q.T)  # a rotation turns two rows
    hi = len(d) - 1
    while hi > 0:
        e[:hi][np.abs(e[:hi]) <= _EPS * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) + np.finfo(float).tiny] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        x, z = d[lo] - (d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))), e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a, b, m = d[k], d[k + 1], e[k]
            d[k] = c * c * a + 2 * c * s * m + s * s * b
            d[k + 1] = s * s * a - 2 * c * s * m + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * m
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, q[order].T
