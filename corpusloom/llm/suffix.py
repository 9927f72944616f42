"""Removal of long repeated byte strings by a sampled, hash-compared suffix sort (operator 10).

A string of so many bytes that starts at two places has, at the same offset in both, the same anchor: the
gram whose hash is least among those inside the string. So it is enough to sort the suffixes that start
at anchors, per gram, to find how far they agree to the right and to the left; the strings that two
anchors share are those within both extensions. Of strings of 400 bytes about one byte in 150 is an anchor.

No two pieces of text count as equal by a polynomial hash alone: neighbours of the sort and strings are
compared byte by byte, surroundings that are settled without their bytes by a 128-bit BLAKE2b digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, n_buckets, release_shuffles, split_by_bucket, text_key, written
from .hashing import mix

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Different surroundings of one gram up to which they are sorted together. Those of a more frequent gram
#: are told apart by ranges of offsets first, PARTS at a time, each dealt out anew by its own hash.
HOT, PARTS = 256, 8
#: Suffixes sorted at once.
SORTED = 4096
#: Bytes of words: all but ASCII white space.
_INK = np.array([chr(c) not in " \t\n\v\f\r" for c in range(256)])

_U = np.uint64
_RNG = np.random.default_rng(77031)
_LETTERS = (_RNG.integers(1, 1 << 62, 256, dtype=np.uint64) << _U(1)) | _U(1)
_BASE = _U(0xB5297A4D3F84D5B5)
_ANCHOR = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("ctx2", "<u8"), ("t1", "<i8"), ("t2", "<u4"), ("pos", "<u4"), ("left", "<u2"), ("right", "<u2"), ("lo", "<u2"), ("hi", "<u2"), ("mult", "u1")])
_SPAN = np.dtype([("t1", "<i8"), ("t2", "<u4"), ("a", "<u4"), ("b", "<u4")])
_GRAM = np.dtype([("key", "<u8"), ("t1", "<i8"), ("t2", "<u4"), ("mult", "u1")])
_REQUEST = np.dtype([("t1", "<i8"), ("t2", "<u4"), ("pos", "<u4"), ("key", "<u8"), ("lo", "<u2"), ("hi", "<u2"), ("mult", "u1"), ("hot", "u1")])


@dataclass(frozen=True)
class Sizes:
    """Bytes of a repeated string, and what follows from them."""

    length: int = LENGTH

    @property
    def k(self) -> int:
        """Bytes of a gram."""
        return max(8, self.length * 6 // 25)

    @property
    def left(self) -> int:
        """Bytes before an anchor that a string around it may have."""
        return self.length - self.k

    @property
    def context(self) -> np.dtype:
        return np.dtype([("key", "<u8"), ("t1", "<i8"), ("t2", "<u4"), ("pos", "<u4"), ("left", "<u2"), ("right", "<u2"), ("mult", "u1"), ("raw", "u1", (self.left + self.length,))])


@dataclass(frozen=True)
class Run(Sizes):
    """Words of a run, and of the gram that tells it: so long a part of it that hardly any shorter run has one."""

    @property
    def k(self) -> int:
        return max(1, self.length * 4 // 5)


def _digests(pieces: Iterator[bytes], bits: int = 128) -> np.ndarray:
    """BLAKE2b digests of byte strings, a row of 64-bit numbers each."""
    blake = hashlib.blake2b
    return np.frombuffer(b"".join([blake(x, digest_size=bits // 8).digest() for x in pieces]), "<u8").reshape(-1, bits // 64)


def _powers(n: int, base) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


_TABLES: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, CHUNK + 4096)
        _TABLES[:] = _powers(size, _BASE), _powers(size, _U(pow(int(_BASE), -1, 1 << 64)))
    return _TABLES


class Prefix:
    """Prefix polynomial hashes of a buffer: the hash of any substring in one step."""

    def __init__(self, raw: np.ndarray, letters: np.ndarray | None = _LETTERS):
        power, self.inverse = _tables(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw if letters is None else letters[raw]) * power[: len(raw)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.inverse[a])


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours, from running values inside blocks of w."""
    n = len(x)
    pad = -n % w
    fill = x.dtype.type(np.iinfo(x.dtype).max if op is np.minimum else 0)
    blocks = np.r_[x, np.full(pad, fill, x.dtype)].reshape(-1, w)
    head = op.accumulate(blocks, axis=1).ravel()
    tail = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def _anchors_of(z: Sizes, raw: np.ndarray, ends: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a buffer of texts that end at ends."""
    n, w, k = len(raw), z.left + 1, z.k
    if n < z.length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n - k + 1)
    v = mix((prefix.total[k:] - prefix.total[: n - k + 1]) * prefix.inverse[: n - k + 1]) | _U(1)
    limit = np.repeat(ends, np.diff(np.r_[0, ends]))  # end of the text that a byte belongs to
    v[at + k > limit[: n - k + 1]] = _U(0xFFFFFFFFFFFFFFFF)
    least = _sliding(v, w, np.minimum)  # of the string at each position
    starts = np.arange(len(least))
    least[starts + z.length > limit[: len(least)]] = 0
    best = _sliding(np.r_[np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)], w, np.maximum)
    found = np.flatnonzero(v == best)
    return found, v[found]


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def text_anchors(texts: list[bytes], z: Sizes = Sizes()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, anchor record without t1 and t2) for groups of texts; a long text comes in chunks
    that overlap by whole strings and their surroundings."""
    for i, j in _groups(texts):
        if j == i + 1 and len(texts[i]) > CHUNK:
            whole, n = texts[i], len(texts[i])
            for off in range(0, n, CHUNK):
                lo, hi = max(0, off - z.length), min(n, off + CHUNK + 3 * z.length)
                rec = _records(z, whole[lo:hi], np.array([hi - lo]), lo)
                rec = rec[(rec["pos"] >= off) & (rec["pos"] < off + CHUNK)]  # all strings around these lie inside
                yield np.full(len(rec), i), rec
        else:
            sizes = np.array([len(t) for t in texts[i:j]])
            ends = np.cumsum(sizes)
            rec = _records(z, b"".join(texts[i:j]), ends, 0)
            text = np.searchsorted(ends, rec["pos"], side="right")
            rec["pos"] -= np.r_[0, ends][text].astype(np.uint32)
            yield text + i, rec


def _records(z: Sizes, buf: bytes, ends: np.ndarray, offset: int) -> np.ndarray:
    raw = np.frombuffer(buf, np.uint8)
    pos, key = _anchors_of(z, raw, ends, Prefix(raw))
    out = np.zeros(len(pos), _ANCHOR)
    text = np.searchsorted(ends, pos, side="right")
    start, end = np.r_[0, ends][text], ends[text] if len(pos) else pos
    left, right = np.minimum(pos - start, z.left), np.minimum(end - pos, z.length)
    out["key"], out["pos"], out["left"], out["right"], out["hi"], out["mult"] = key, pos + offset, left, right, z.left, 1
    d = _digests(n.to_bytes(2) + buf[a:b] for n, a, b in zip(left.tolist(), (pos - left).tolist(), (pos + right).tolist()))
    out["ctx"], out["ctx2"] = d[:, 0], d[:, 1]
    return out


def _word_hashes(buf: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a buffer of texts that end at ends, and where each text's words end."""
    raw = np.frombuffer(buf, np.uint8)
    ink = _INK[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    first[ends[ends < len(raw)]] = ink[ends[ends < len(raw)]]
    last[ends[ends > 0] - 1] = ink[ends[ends > 0] - 1]
    a = np.flatnonzero(first)
    return Prefix(raw).of(a, np.flatnonzero(last) + 1), np.searchsorted(a, ends)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK bytes that end at white space."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        while to < len(text) and _INK[text[to]]:
            to += 1
        yield text[at:to]
        at = to


def text_grams(texts: list[bytes], run: Run) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, gram's hash), each once a text, for groups of texts: one gram at least of each run of words."""
    for i, j in _groups(texts):
        if len(texts[i]) > CHUNK:
            words = np.concatenate([_word_hashes(x, np.array([len(x)]))[0] for x in _pieces(texts[i])])
            ends = np.array([len(words)])
        else:
            words, ends = _word_hashes(b"".join(texts[i:j]), np.cumsum([len(t) for t in texts[i:j]]))
        pos, key = _anchors_of(run, words, ends, Prefix(words, None))
        text = np.searchsorted(ends, pos, side="right")
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.r_[True, (text[1:] != text[:-1]) | (key[1:] != key[:-1])][: len(text)]
        yield text[new] + i, key[new]


def _each(g: np.ndarray) -> np.ndarray:
    """Grams once a text."""
    g = g[np.lexsort((g["key"], g["t2"], g["t1"]))]
    return g[np.r_[True, (g["t1"][1:] != g["t1"][:-1]) | (g["t2"][1:] != g["t2"][:-1]) | (g["key"][1:] != g["key"][:-1])][: len(g)]]


def _common(g: np.ndarray, buckets: int, last: bool) -> list:
    """Of grams, each once a row of the table, those of several rows by bucket of their text (kind 4). In a
    batch one of each gram goes on (kind 3), counting as two if it is of several rows, until the last."""
    g = g[np.argsort(g["key"], kind="stable")]
    first = np.r_[True, g["key"][1:] != g["key"][:-1]][: len(g)]
    cls = np.cumsum(first) - 1
    n = np.bincount(cls, g["mult"]).astype(np.int64)
    own = _each(g[(n[cls] > 1) & (g["mult"] == 1)])
    rows = _rows(4, own["t1"] % buckets, own) if len(own) else []
    one = g[first]
    one["mult"] = np.minimum(n, 2)
    return rows if last or not len(one) else rows + _rows(3, (one["key"] % _U(buckets)).astype(np.int64), one)


def _spans(t1, t2, a, b) -> np.ndarray:
    out = np.empty(len(t1), _SPAN)
    out["t1"], out["t2"], out["a"], out["b"] = t1, t2, a, b
    return out


def _distinct(s: np.ndarray) -> np.ndarray:
    """Spans without those that repeat or lie within others of their text."""
    s = s[np.lexsort((-s["b"].astype(np.int64), s["a"], s["t2"], s["t1"]))]
    text = np.cumsum(np.r_[True, (s["t1"][1:] != s["t1"][:-1]) | (s["t2"][1:] != s["t2"][:-1])]) if len(s) else np.empty(0, np.int64)
    top = np.maximum.accumulate((text.astype(np.int64) << 32) + s["b"])
    return s[np.r_[True, (text[1:] << 32) + s["b"][1:] > top[:-1]]] if len(s) else s


def _combined(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by gram and surroundings, the class of each, and whether it has more than one member."""
    for by in (("key", "ctx"), ("key", "ctx", "ctx2")):
        own = r[np.lexsort([r[c] for c in reversed(by)])]
        new = np.zeros(len(own), bool)
        new[:1] = True
        for c in by:
            new[1:] |= own[c][1:] != own[c][:-1]
        if not (own["ctx2"][1:] != own["ctx2"][:-1])[~new[1:]].any():
            break  # else half a digest isn't enough here
    cls = np.cumsum(new) - 1
    return own, cls, np.bincount(cls, own["mult"]) >= 2 if len(own) else np.empty(0, bool)


def _rows(kind: int, bucket: np.ndarray, records: np.ndarray) -> list[tuple[int, int, bytes]]:
    import zstandard

    return [(kind, b, zstandard.compress(x, 1)) for b, x in split_by_bucket(bucket, records)]


def _cat(blobs, dtype) -> np.ndarray:
    import zstandard

    return np.frombuffer(b"".join(zstandard.decompress(x) for x in blobs), dtype)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "blob"])


def _find_anchors(z: Sizes, buckets: int, run_of: Run | None = None):
    """Anchors by bucket of their gram. Equal surroundings within a batch are settled here: they give
    spans (kind 0), and one of them goes on (kind 1), counting as two. With run_of the grams of words
    too (kinds 3 and 4, see _common)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                least = min(z.length, 8 * run_of.length - 4) if run_of else z.length
                texts = [t.encode() if isinstance(t, str) and len(t) * 4 >= least else b"" for t in pdf["text"]]
                t1, t2 = pdf["k1"].to_numpy(np.int64), pdf["k2"].to_numpy(np.int64).astype(np.uint32)
                found = []
                for text, rec in text_anchors(texts, z):
                    rec["t1"], rec["t2"] = t1[text], t2[text]
                    found.append(rec)
                r = np.concatenate(found) if found else np.empty(0, _ANCHOR)
                rows = _dealt(r, buckets)
                grams = list(text_grams(texts, run_of)) if run_of else []
                if sum(len(key) for _, key in grams):
                    text = np.concatenate([x for x, _ in grams])
                    g = np.empty(len(text), _GRAM)
                    g["key"], g["t1"], g["t2"], g["mult"] = np.concatenate([key for _, key in grams]), t1[text], t2[text], 1
                    rows += _common(g, buckets, False)
                if rows:
                    yield _frame(rows)

    return run


def _dealt(r: np.ndarray, buckets: int) -> list:
    """Rows of a batch's records by bucket of their gram. Equal surroundings within the batch are settled
    here: they give spans (kind 0), and one of them goes on (kind 1), counting as two."""
    if not len(r):
        return []
    r, cls, twice = _combined(r)
    rows, d = [], r[twice[cls]]
    if len(d):
        s = _distinct(_spans(d["t1"], d["t2"], d["pos"] - d["left"], d["pos"] + d["right"]))
        rows += _rows(0, s["t1"] % buckets, s)
    one = r[np.r_[True, cls[1:] != cls[:-1]]].copy()
    one["mult"] = np.minimum(np.bincount(cls, r["mult"]), 2)
    return rows + _rows(1, (one["key"] % _U(buckets)).astype(np.int64), one)


def _classes(r: np.ndarray, buckets: int, hot: int) -> list:
    """Of the records of one bucket: spans of repeated surroundings (kind 0), and requests (kind 1) for
    the bytes around grams with several surroundings of which one at least isn't settled."""
    r, cls, twice = _combined(r)
    rows, d = [], r[twice[cls]]
    if len(d):
        rows += _rows(0, d["t1"] % buckets, _spans(d["t1"], d["t2"], d["pos"] - d["left"], d["pos"] + d["right"]))
    one = r[np.r_[True, cls[1:] != cls[:-1]]]
    group = np.cumsum(np.r_[True, one["key"][1:] != one["key"][:-1]]) - 1
    size, open_ = np.bincount(group), np.bincount(group, ~twice) > 0
    ask = ((size >= 2) & open_)[group]
    q = np.zeros(int(ask.sum()), _REQUEST)
    for c in ("t1", "t2", "pos", "key", "lo", "hi"):
        q[c] = one[c][ask]
    q["mult"], q["hot"] = 1 + twice[ask], size[group][ask] > hot
    return rows + (_rows(1, q["t1"] % buckets, q) if len(q) else [])


def _reduced(z: Sizes, buckets: int, hot: int):
    """One bucket of rows of any kind: spans go on (0), records become spans and requests (1), the
    surroundings that were asked for become spans (2), grams of words those of several rows (4)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, kind = [], pdf["kind"]
        with np.errstate(over="ignore"):
            old = [_cat(pdf["blob"][kind == 0], _SPAN)]
            r = _cat(pdf["blob"][kind == 1], _ANCHOR)
            if len(r):
                rows += _classes(r, buckets, hot)
            rows += _common(_cat(pdf["blob"][kind == 3], _GRAM), buckets, True)
            g = _each(_cat(pdf["blob"][kind == 4], _GRAM))
            rows += _rows(4, g["t1"] % buckets, g) if len(g) else []
            c = _cat(pdf["blob"][kind == 2], z.context)
            if len(c):
                c = c[np.lexsort((c["pos"], c["t2"], c["t1"], c["key"]))]
                c = c[np.r_[True, np.any([c[f][1:] != c[f][:-1] for f in ("key", "t1", "t2", "pos")], axis=0)]]
                ends = np.r_[np.flatnonzero(c["key"][1:] != c["key"][:-1]) + 1, len(c)]
                at = 0
                while at < len(c):
                    to = max(int(ends[np.searchsorted(ends, at, side="right")]), int(ends[max(0, np.searchsorted(ends, at + SORTED, side="right") - 1)]))
                    old.append(_shared(z, c[at:to]))
                    at = to
            s = _distinct(np.concatenate(old))
            if len(s):
                rows += _rows(0, s["t1"] % buckets, s)
        return _frame(rows)

    return run


def _by_text(dtype, merge: bool):
    """Records of one bucket of texts -> one row for each text; spans are merged where they touch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _cat(pdf["blob"], dtype)
        r = r[np.lexsort((r["a" if merge else "pos"], r["t2"], r["t1"]))]
        cuts = np.flatnonzero(np.r_[True, (r["t1"][1:] != r["t1"][:-1]) | (r["t2"][1:] != r["t2"][:-1])]) if len(r) else []
        rows = []
        for k, at in enumerate(cuts):
            own = r[at : cuts[k + 1] if k + 1 < len(cuts) else len(r)]
            if merge:
                top = np.maximum.accumulate(own["b"])
                new = np.r_[True, own["a"][1:] > top[:-1]]
                last = np.r_[np.flatnonzero(new)[1:] - 1, len(own) - 1]
                body = np.stack([own["a"][new], top[last]], axis=1).astype("<u4").tobytes()
            else:
                body = own.tobytes()
            rows.append((int(own["t1"][0]), int(own["t2"][0]), body))
        return pd.DataFrame(rows, columns=["k1", "k2", "body"])

    return run


def _ended(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans (kind 0) and grams (kind 4) of one bucket of texts -> one row for each text."""
    spans = _by_text(_SPAN, True)(pdf[pdf["kind"] == 0])
    g = _each(_cat(pdf["blob"][pdf["kind"] == 4], _GRAM))
    grams = pd.DataFrame({"k1": g["t1"], "k2": g["t2"].astype(np.int64)}).groupby(["k1", "k2"]).size().rename("grams").reset_index()
    out = spans.astype({"k1": np.int64, "k2": np.int64}).merge(grams, on=["k1", "k2"], how="outer")
    return out.assign(body=out["body"].where(out["body"].notna(), None), grams=out["grams"].fillna(0).astype(np.int64))


def _answer(z: Sizes, buckets: int):
    """The bytes around the anchors that were asked for (kind 2); around frequent grams, records of parts
    of their range of offsets instead (kinds 0 and 1, see _parts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                contexts, parts = [np.empty(0, z.context)], [np.empty(0, _ANCHOR)]
                for text, body in zip(pdf["text"], pdf["body"]):
                    q = np.frombuffer(body, _REQUEST)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    for k in range(0, len(q), 512):
                        own = q[k : k + 512]
                        c = np.zeros(len(own), z.context)
                        for f in ("key", "t1", "t2", "pos", "mult"):
                            c[f] = own[f]
                        pos = own["pos"].astype(np.int64)
                        c["left"], c["right"] = np.minimum(pos, z.left), np.minimum(len(raw) - pos, z.length)
                        at = pos[:, None] + np.arange(-z.left, z.length)
                        c["raw"] = np.where((at >= 0) & (at < len(raw)), raw[np.clip(at, 0, len(raw) - 1)], 0)
                        hot = own["hot"] > 0
                        if hot.any():
                            parts.append(_parts(z, c[hot], own[hot]))
                        if not hot.all():
                            contexts.append(c[~hot])
                c = np.concatenate(contexts)
                yield _frame(_dealt(np.concatenate(parts), buckets) + (_rows(2, (c["key"] % _U(buckets)).astype(np.int64), c) if len(c) else []))

    return run


def _parts(z: Sizes, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Records for PARTS ranges of offsets within each request's range: their gram is what all strings of
    the range have in common, their surroundings what they cover together, both named by their digests."""
    raw = [x.tobytes() for x in c["raw"]]
    out = []
    step = -(-(q["hi"].astype(np.int64) - q["lo"] + 1) // PARTS)
    for k in range(PARTS):
        lo = q["lo"] + k * step
        hi = np.minimum(q["hi"], lo + step - 1)
        who = np.flatnonzero((lo <= hi) & (np.maximum(lo, z.length - c["right"].astype(np.int64)) <= np.minimum(hi, c["left"])))
        lo, hi = lo[who], hi[who]
        r = np.zeros(len(who), _ANCHOR)
        r["left"], r["right"] = np.minimum(hi, c["left"][who]), np.minimum(z.length - lo, c["right"][who])
        place = [w.to_bytes(8) + a.to_bytes(2) + b.to_bytes(2) for w, a, b in zip(c["key"][who].tolist(), lo.tolist(), hi.tolist())]
        cores = [raw[i][z.left - a : z.left + z.length - b] for i, a, b in zip(who.tolist(), lo.tolist(), hi.tolist())]
        r["key"] = _digests((p + x for p, x in zip(place, cores)), 64)[:, 0]
        d = _digests(p + a.to_bytes(2) + raw[i][z.left - a : z.left + b] for p, i, a, b in zip(place, who.tolist(), r["left"].tolist(), r["right"].tolist()))
        r["ctx"], r["ctx2"] = d[:, 0], d[:, 1]
        r["t1"], r["t2"], r["pos"], r["mult"], r["lo"], r["hi"] = c["t1"][who], c["t2"][who], c["pos"][who], q["mult"][who], lo, hi
        out.append(r)
    return np.concatenate(out)


def _halves(z: Sizes, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of the bytes from the anchor rightwards and leftwards, for each context."""
    power = _tables(z.length + 1)[0]
    out = []
    for part in (c["raw"][:, z.left :], c["raw"][:, : z.left][:, ::-1]):
        h = np.zeros((len(c), part.shape[1] + 1), np.uint64)
        np.cumsum(_LETTERS[part] * power[: part.shape[1]], axis=1, out=h[:, 1:])
        out.append(h)
    return out[0], out[1]


def _strings(z: Sizes, c: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, bytes before the anchor) of the strings around the anchors of the given rows that lie
    inside their texts and whose hash isn't alone, sorted by hash."""
    own = c[rows]
    r = np.arange(z.left + 1)
    who, back = np.nonzero((r <= own["left"][:, None]) & (z.length - r <= own["right"][:, None]))
    right, left = _halves(z, own)
    h = mix(right[who, z.length - back] * _U(3) + mix(left[who, back] + back.astype(np.uint64)) + own["key"][who])
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(h) else order
    return h[order], rows[who[order]], back[order]


def _borne_out(z: Sizes, c: np.ndarray, h: np.ndarray, row: np.ndarray, back: np.ndarray) -> bool:
    """Whether the bytes bear out the classes of equal hashes, which lie side by side: the stretch of all
    equal strings of two neighbours is compared at once."""
    same = h[1:] == h[:-1]
    if (back[1:] != back[:-1])[same].any():
        return False
    pair, back = (row[:-1] << 32 | row[1:])[same], back[1:][same]
    order = np.lexsort((back, pair))
    pair, back = pair[order], back[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
    last = np.r_[first[1:] - 1, len(pair) - 1] if len(pair) else first
    at = np.arange(z.left + z.length)
    for k in range(0, len(first), 512):
        p, lo, hi = pair[first[k : k + 512]], back[first[k : k + 512]], back[last[k : k + 512]]
        inside = (at >= z.left - hi[:, None]) & (at < z.left - lo[:, None] + z.length)
        if ((c["raw"][p >> 32] != c["raw"][p & 0xFFFFFFFF]) & inside).any():
            return False
    return True


class Suffixes:
    """Suffixes (or reversed prefixes) of equal grams, compared by their prefix hashes."""

    def __init__(self, hashes: np.ndarray, raw: np.ndarray, sizes: np.ndarray):
        self.h, self.raw, self.sizes = hashes, raw, sizes.astype(np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that a and b have in common, by binary search over the hashes of their prefixes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.h[a, mid] == self.h[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
        """Whether the bytes bear the common lengths out: equal so far, different behind."""
        inside = np.arange(self.raw.shape[1]) < n[:, None]
        if ((self.raw[a] != self.raw[b]) & inside).any():
            return False
        more = n < np.minimum(self.sizes[a], self.sizes[b])
        return bool((self.raw[a[more], n[more]] != self.raw[b[more], n[more]]).all())

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        end = n >= np.minimum(self.sizes[a], self.sizes[b])
        at = np.minimum(n, self.raw.shape[1] - 1)
        shorter = (self.sizes[a] < self.sizes[b]) | ((self.sizes[a] == self.sizes[b]) & (a < b))
        return np.where(end, shorter, self.raw[a, at] < self.raw[b, at])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within groups of neighbours: mergesort from runs of one upwards, all
        groups at once; a suffix finds its place in the run beside its own by binary search."""
        n = len(group)
        first = np.searchsorted(group, group)
        size = np.bincount(group)[group]
        order, width = np.arange(n), 1
        while width < size.max(initial=0):
            slot = np.arange(n) - first
            run = slot // width
            lo = first + (run ^ 1) * width
            hi = np.minimum(lo + width, first + size)
            act = np.flatnonzero(lo < hi)
            l, h, base = lo[act].copy(), hi[act].copy(), lo[act]
            while len(todo := np.flatnonzero(l < h)):
                mid = (l[todo] + h[todo]) >> 1
                before = self.less(order[mid], order[act[todo]])
                l[todo], h[todo] = np.where(before, mid + 1, l[todo]), np.where(before, h[todo], mid)
            place = np.arange(n)
            place[act] = first[act] + (run[act] & ~1) * width + slot[act] - run[act] * width + l - base
            moved = np.empty(n, np.int64)
            moved[place] = order
            order, width = moved, 2 * width
        return order


def _shared(z: Sizes, c: np.ndarray) -> np.ndarray:
    """Spans of the strings that contexts of equal grams share; c is sorted by key."""
    group = np.cumsum(np.r_[True, c["key"][1:] != c["key"][:-1]]) - 1
    right, left = _halves(z, c)
    sides = [Suffixes(right, c["raw"][:, z.left :], c["right"]), Suffixes(left, c["raw"][:, : z.left][:, ::-1], c["left"])]
    partner, best = [], []
    for side in sides:
        order = side.sort(group)
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        a, b = a[same], b[same]
        n = side.common(a, b)
        if not side.verified(a, b, n):  # two different prefixes had one hash: settle by the strings themselves
            return _slowly(z, c)
        most = np.zeros(len(c), np.int64)
        np.maximum.at(most, a, n)
        np.maximum.at(most, b, n)
        best.append(most)
        partner += [(a, b), (b, a)]
    low, high = z.length - best[0], np.minimum(best[1], z.left)
    open_ = (low <= high) & (c["mult"] == 1)
    out = []
    for a, b in partner:
        a, b = a[open_[a]], b[open_[a]]
        to_right, to_left = sides[0].common(a, b), sides[1].common(a, b)
        ok = to_right + to_left >= z.length
        out.append(_spans(c["t1"][a[ok]], c["t2"][a[ok]], c["pos"][a[ok]] - to_left[ok], c["pos"][a[ok]] + to_right[ok]))
        open_[a[(to_right == best[0][a]) & (to_left == high[a])]] = False  # nobody shares more
    if open_.any():
        some = np.flatnonzero(np.isin(group, group[open_]))
        h, row, back = _strings(z, c, some)
        if not _borne_out(z, c, h, row, back):
            return _slowly(z, c)
        out.append(_spans(c["t1"][row], c["t2"][row], c["pos"][row] - back, c["pos"][row] - back + z.length))
    return np.concatenate(out)


def _slowly(z: Sizes, c: np.ndarray) -> np.ndarray:
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for k in range(len(c)):
        for back in range(max(0, z.length - int(c["right"][k])), int(c["left"][k]) + 1):
            seen.setdefault(c["key"][k].tobytes() + back.to_bytes(2) + c["raw"][k, z.left - back : z.left - back + z.length].tobytes(), []).append((k, back))
    hit = [x for own in seen.values() if len(own) > 1 for x in own]
    k, back = np.array([x[0] for x in hit], int), np.array([x[1] for x in hit], int)
    return _spans(c["t1"][k], c["t2"][k], c["pos"][k] - back, c["pos"][k] - back + z.length)


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, run_words: int = 0) -> DataFrame:
    """(k1, k2, body, grams): for each text of docs(doc_id, text, k1, k2) with repeated bytes, its merged
    spans as pairs of 32-bit offsets, and with run_words the number of its grams that another row has
    too (see remove_repeats; such a text may have no spans: null). k2 holds 32 bits."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets, z = n_buckets(spark, 2), Sizes(length)
    rows = "kind int, bucket int, blob binary"
    mapped, texts, spans, made = docs.select("text", "k1", "k2").mapInPandas(_find_anchors(z, buckets, Run(run_words) if run_words else None), rows), None, None, []
    while mapped is not None:
        found = written(mapped.groupBy("bucket").applyInPandas(_reduced(z, buckets, hot), rows), "suffix-found")
        made.append(found)
        release_shuffles(spark)
        own = found.where("kind in (0, 4)")
        spans = own if spans is None else spans.union(own)
        ask = found.where("kind = 1").select("bucket", "blob").groupBy("bucket").applyInPandas(_by_text(_REQUEST, False), "k1 long, k2 long, body binary")
        if texts is None:
            name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00"))
            named = docs.select("k1", "k2", name.alias("d"), "text")
            first = named.groupBy("k1", "k2").agg(F.min("d").alias("d"))
            asked = texts = written(ask.join(first, ["k1", "k2"]).join(named, ["k1", "k2", "d"]).select("k1", "k2", "text", "body"), "suffix-texts")
            made.append(texts)
            release_shuffles(spark)
        else:
            asked = ask.join(texts.drop("body"), ["k1", "k2"])
        # each round narrows the ranges of frequent grams, from all offsets to one: at most four rounds
        mapped = None if found.where("kind = 1").isEmpty() else asked.select("text", "body").mapInPandas(_answer(z, buckets), rows)
    out = written(spans.groupBy("bucket").applyInPandas(_ended, "k1 long, k2 long, body binary, grams long"), "suffix-spans")
    for table in made:
        drop_written(table)
    return out


def _plain(docs: DataFrame, c: str):
    """A column as text: pandas would turn whole numbers with nulls into floats."""
    return F.col(c).cast("string")


def _words(raw: bytes) -> int:
    return len(raw.split())


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False, hot: int = HOT, length: int = LENGTH, over_words: int = 0, run_words: int = 0) -> DataFrame:
    """The carried columns of every row of docs, then n_bytes, n_removed, n_spans, kept_sha256, and with
    with_text the remaining text as kept (a character that a cut splits is left out), and with run_words
    n_shared_grams.

    Every byte covered by a string of length bytes that also starts elsewhere goes, in all copies; with
    over_words only those in runs of more than so many words, cut words included. Null text counts as
    empty; a text is named by 96 bits of its hashes, so repeated rows and equal texts get equal results;
    null ids take part; an empty table gives no rows; other columns are never read.

    n_shared_grams counts the different grams of run_words * 4 // 5 words that another row has too. Every
    run of run_words words has one at least (that of least hash), so a row that shares such a run has 1 or
    more, and a row that has any shares a gram's words with another. What repeats within one row only
    doesn't count, and nothing is removed for it. Grams are told apart by 64 bits of hashes of words."""
    keyed = docs.select(*[_plain(docs, c).alias(f"c{k}") for k, c in enumerate(carry)], F.col("doc_id"), F.col("text"), *text_key(F.col("text"))).withColumn("k2", F.col("k2").bitwiseAND(F.lit(0xFFFFFFFF)))
    spans = repeated_spans(keyed, length, hot, run_words)
    own = [f"c{k}" for k in range(len(carry))]
    # merged at every size: a broadcast for small inputs alone would only hide how the plan grows
    rows = keyed.drop("doc_id").join(spans.hint("merge"), ["k1", "k2"], "left").select(*own, "text", "body", F.coalesce("grams", F.lit(0)).alias("grams"))
    schema = ", ".join(f"c{k} string" for k in range(len(carry))) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + ", n_shared_grams long" * bool(run_words)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, body, grams in zip(pdf["text"], pdf["body"], pdf["grams"]):
                raw = text.encode() if isinstance(text, str) else b""
                kept, removed, n = raw, 0, 0
                if body is not None:
                    s = [(a, b) for a, b in np.frombuffer(body, "<u4").reshape(-1, 2).tolist() if not over_words or _words(raw[a:b]) > over_words]
                    kept = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in s]], [*[a for a, _ in s], len(raw)]))
                    removed, n = len(raw) - len(kept), len(s)
                out.append((len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "ignore")] * with_text, *[grams] * bool(run_words)))
            cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text, *["n_shared_grams"] * bool(run_words)]
            yield pd.concat([pdf[own].reset_index(drop=True), pd.DataFrame(out, columns=cols)], axis=1)

    result = rows.mapInPandas(cut, schema)
    return result.select(*[F.col(f"c{k}").cast(docs.schema[c].dataType).alias(c) for k, c in enumerate(carry)], "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text, *["n_shared_grams"] * bool(run_words))
