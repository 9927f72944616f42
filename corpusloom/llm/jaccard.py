"""N-gram Jaccard join: rare-first prefix filtering (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, n_buckets, split_by_bucket, written
from .components import components
from .hashing import LOWER, mix, word_hashes

N, NUM, DEN = 5, 80, 100
#: Counters of the sketch of shingle frequencies, a fixed 4 MB; it only orders shingles.
SKETCH_BITS = 20
#: Counters of the suffix filter: shingles of a document by a few bits of their hash.
CELLS = 32
#: Members that are compared with one copy of a pivot's text, and members of a block of a list, about.
GROUP, BLOCK = 64, 1024
#: Rows up to which a table about lists is sent to all tasks; beyond, it is joined by shuffling.
SENT = 200_000

_POSTING = np.dtype([("g", "<u4"), ("s", "<i8"), ("n", "<u4"), ("p", "<u4")])


def _lower(texts) -> list[bytes]:
    return [t.encode().translate(LOWER) if isinstance(t, str) else b"" for t in texts]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of the N-word shingles of each text; fewer words: one of them all."""
    for _, h, at in word_hashes(texts):
        wide = np.zeros(max(0, len(h) - N + 1), np.uint64)
        for k in range(N):
            wide = wide * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(wide)]
        wide = mix(wide)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= N:
                yield np.unique(wide[a : b - N + 1])
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = mix(np.array([one * np.uint64(0xA0761D6478BD642F) + x]))[0]
                yield np.array([one])
            else:
                yield np.empty(0, np.uint64)


def signature(s: np.ndarray, seed: int = 0) -> int:
    """64 bits that name a set."""
    word = np.uint64((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)[seed])
    return int(mix(np.array([np.sum(mix(s ^ word)) + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


def named(s: np.ndarray, shared: frozenset[int]) -> int:
    """The name of a set: its first 64 bits, or the second ones where different sets share the first."""
    first = signature(s)
    return signature(s, 1) if first in shared else first


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row's set in short, and at the end this task's slices of the frequency sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    with np.errstate(over="ignore"):
        for pdf in batches:
            rows, seen = [], []
            for s in shingle_sets(_lower(pdf["text"])):
                cells = np.minimum(np.bincount((s >> np.uint64(35)).astype(np.int64) % CELLS, minlength=CELLS), 65535).astype("<u2")
                rows.append((signature(s), signature(s, 1), len(s), cells.tobytes()))
                seen.append(s)
                if len(seen) >= 512:
                    sketch += np.bincount((np.concatenate(seen) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                    seen = []
            if seen:
                sketch += np.bincount((np.concatenate(seen) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            out = pd.DataFrame(rows, columns=["s", "s2", "n", "cells"])
            yield out.assign(doc_id=pdf["doc_id"].to_numpy(), k=pdf["k"].to_numpy(), slice=-1)[["slice", "doc_id", "k", "s", "s2", "n", "cells"]]
    if sketch.any():
        parts = sketch.reshape(16, -1)
        yield pd.DataFrame({"slice": range(16), "doc_id": None, "k": 0, "s": 0, "s2": 0, "n": 0, "cells": [x.tobytes() for x in parts]})


def _sum_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.uint32).astype(np.uint64) for x in pdf["cells"]], axis=0)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "cells": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]})


def _postings(sketch, shared: frozenset[int], buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.frombuffer(sketch.value, np.uint32)
        with np.errstate(over="ignore"):
            for pdf in batches:
                done, found, to = set(), [], []
                for s in shingle_sets(_lower(pdf["text"])):
                    n = len(s)
                    sig = named(s, shared)
                    if n == 0 or sig in done:
                        continue
                    done.add(sig)
                    top = s[np.argsort(df[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[: n - (NUM * n + DEN - 1) // DEN + 1]]
                    rows = np.empty(len(top), _POSTING)
                    rows["g"], rows["s"], rows["n"], rows["p"] = top.astype(np.uint32), sig, n, np.arange(len(top))
                    found.append(rows)
                    to.append((top >> np.uint64(32)).astype(np.int64) % buckets)
                if found:
                    yield pd.DataFrame([(b, _squeeze(x)) for b, x in split_by_bucket(np.concatenate(to), np.concatenate(found))], columns=["bucket", "blob"])

    return run


def _squeeze(records: bytes) -> bytes:
    import zstandard

    r = np.frombuffer(records, _POSTING)
    return zstandard.compress(b"".join(r[c].tobytes() for c in _POSTING.names), 1)


def _unsqueeze(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.decompress(blob)
    out, at = np.empty(len(raw) // _POSTING.itemsize, _POSTING), 0
    for c in _POSTING.names:
        out[c] = np.frombuffer(raw, _POSTING[c], len(out), at)
        at += _POSTING[c].itemsize * len(out)
    return out


def _candidates(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: each list's documents with its first one (filtered by length and position), and
    the lists of three and more whole (a = 0), as rows (g, a, b, n, p)."""
    r = np.concatenate([_unsqueeze(x) for x in pdf["blob"]])
    r = np.unique(r[["g", "p", "s", "n"]])  # a list begins with the document that has fewest rarer shingles
    new = np.r_[True, r["g"][1:] != r["g"][:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(r)])
    head, many = np.repeat(first, size), np.repeat(size, size)
    keep = many >= 2
    r, x, many, is_head = r[keep], r[head[keep]], many[keep], new[keep]
    g = r["g"].astype(np.int64) << 31 | int(key[0])
    nx, ny = x["n"].astype(np.int64), r["n"].astype(np.int64)
    rest = np.minimum(nx - x["p"], ny - r["p"])
    ok = ~is_head & (DEN * np.minimum(nx, ny) >= NUM * np.maximum(nx, ny)) & ((NUM + DEN) * rest >= NUM * (nx + ny))
    pairs = pd.DataFrame({"a": x["s"][ok], "b": r["s"][ok]}).drop_duplicates()
    pairs = pairs.assign(kind=0, g=0, n=0, p=0)
    wide = many >= 3
    lists = pd.DataFrame({"kind": 1, "g": g[wide], "a": 0, "b": r["s"][wide], "n": ny[wide], "p": r["p"][wide].astype(np.int64)})
    return pd.concat([pairs, lists], ignore_index=True)[["kind", "g", "a", "b", "n", "p"]]


def _suffix_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose cell counts allow the overlap: the counts' differences bound the symmetric one."""
    for pdf in batches:
        if len(pdf):
            c = [np.frombuffer(b"".join(pdf[k]), "<u2").reshape(-1, CELLS).astype(np.int64) for k in ("ca", "cb")]
            total = (pdf["na"] + pdf["nb"]).to_numpy()
            least = np.abs(c[0] - c[1]).sum(axis=1)
            yield pdf[(NUM + DEN) * least <= (DEN - NUM) * total][["a", "b"]]


def _verify(shared: frozenset[int]):
    """Rows sorted by pivot, salt and role, a pivot's text before its members': the pairs that link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, own = None, None
        with np.errstate(over="ignore"):
            for pdf in batches:
                out = []
                for x, salt, role, member, s in zip(pdf["x"], pdf["salt"], pdf["role"], pdf["member"], shingle_sets(_lower(pdf["text"]))):
                    if named(s, shared) != member:
                        continue
                    if role == 0:
                        name, own = (x, salt), s
                    elif name == (x, salt):
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if DEN * both >= NUM * (len(own) + len(s) - both):
                            out.append((x, member))
                yield pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    return run


def _across(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs within the lists of rows (g, s, n, p, c) of different components c that pass the
    filters of length and position.

    A list that holds several components is cut into classes of sizes, of which only neighbours can link,
    and each class into blocks of about BLOCK members; pairs of blocks meet, so that a task never holds
    more than two blocks of a list. Rows move by list only where the table of blocks is large."""
    rows = rows.withColumn("l", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).cast("int"))
    sizes = written(rows.groupBy("g", "l").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of"), F.min("c").alias("lo"), F.max("c").alias("hi")), "jaccard-lists")
    mixed = sizes.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("g")
    # a power of DEN / NUM may come out on either side of its bound, so that classes two apart meet, too
    steps = [F.struct(F.col("of").alias("to"), F.lit(k).alias("step")) for k in range(-2, 3)]
    near = sizes.select("g", F.col("l").alias("other"), F.explode(F.array(*steps)).alias("x")).select("g", (F.col("other") - F.col("x.step")).alias("l"), "x.step", "x.to")
    table = sizes.join(mixed, "g", "left_semi").select("g", "l", "of").join(near, ["g", "l"]).groupBy("g", "l").agg(F.first("of").alias("of"), F.collect_list(F.struct("step", "to")).alias("near"))
    table = written(table, "jaccard-blocks")
    table = F.broadcast(table) if table.count() <= SENT else table
    cut = rows.join(table, ["g", "l"]).withColumn("i", F.pmod(F.xxhash64("s"), F.col("of")).cast("int"))
    every = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["to"] - 1), lambda j: F.struct((F.col("l") + x["step"]).alias("l"), j.alias("i")))))
    above = F.filter(every, lambda x: (x["l"] > F.col("l")) | ((x["l"] == F.col("l")) & (x["i"] >= F.col("i"))))
    below = F.filter(every, lambda x: (x["l"] < F.col("l")) | ((x["l"] == F.col("l")) & (x["i"] <= F.col("i"))))
    side = lambda k, to, own, other: cut.select(*[F.col(c).alias(c + k) for c in "snpc"], "g", F.col("l").alias("l" + own), F.col("i").alias("i" + own), F.explode(to).alias("to")).select(*[c + k for c in "snpc"], "g", "l" + own, "i" + own, F.col("to.l").alias("l" + other), F.col("to.i").alias("i" + other))
    once = (F.col("l1") < F.col("l2")) | (F.col("i1") < F.col("i2")) | (F.col("sx") < F.col("sy"))
    both = side("x", above, "1", "2").join(side("y", below, "2", "1"), ["g", "l1", "i1", "l2", "i2"])
    both = both.where(once & F.expr(f"cx <> cy AND {DEN} * least(nx, ny) >= {NUM} * greatest(nx, ny) AND {NUM + DEN} * least(nx - px, ny - py) >= {NUM} * (nx + ny)"))
    return both.select(F.least("sx", "sy").alias("a"), F.greatest("sx", "sy").alias("b")).distinct()


class Join:
    """The sets of a table of documents, and which of them link."""

    def __init__(self, docs: DataFrame):
        spark = self.spark = docs.sparkSession
        bounded_batches(spark)
        kind = docs.schema["doc_id"].dataType
        plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas would turn whole numbers with nulls into floats
        self.docs = plain.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k"))
        first = written(self.docs.mapInPandas(_summaries, "slice int, doc_id string, k long, s long, s2 long, n long, cells binary"), "jaccard-sets")
        # sets are told apart by 128 bits: the few that share their first 64 (n * n / 2 ** 65 of n sets) take the others
        several = first.where("slice < 0").groupBy("s").agg(F.min("s2").alias("lo"), F.max("s2").alias("hi")).where("lo < hi")
        self.shared = frozenset(r["s"] for r in several.select("s").collect())
        name = F.when(F.col("s").isin(*self.shared), F.col("s2")).otherwise(F.col("s")) if self.shared else F.col("s")
        self.rows = first.where("slice < 0").select(F.col("doc_id").cast(kind).alias("doc_id"), "k", name.alias("s"), "n", "cells")
        slices = {r["slice"]: bytes(r["cells"]) for r in first.where("slice >= 0").select("slice", "cells").groupBy("slice").applyInPandas(_sum_slices, "slice int, cells binary").collect()}
        sketch = b"".join(slices.get(k, bytes((4 << SKETCH_BITS) // 16)) for k in range(16))
        self.sketch = spark.sparkContext.broadcast(sketch)
        #: One row of documents for each set, to fetch its text by.
        self.reps = written(
            self.rows.where("n > 0").groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k")).alias("r"), F.first("n").alias("n"), F.first("cells").alias("cells"))
            .select("s", "n", "cells", F.col("r.doc_id").cast("string").alias("d"), F.col("r.k").alias("k")), "jaccard-reps",
        )

    def links(self) -> DataFrame:
        """(a, b): links between signatures of different sets, enough of them to connect every component
        as all links would: within a list the first document is compared with every other; where a list
        then still holds documents of different components, each pair of those that passes the filters."""
        buckets = n_buckets(self.spark)
        lists = self.docs.select("text").mapInPandas(_postings(self.sketch, self.shared, buckets), "bucket int, blob binary")
        found = written(lists.groupBy("bucket").applyInPandas(_candidates, "kind int, g long, a long, b long, n long, p long"), "jaccard-candidates")
        pairs = written(found.where("kind = 0").select("a", "b").distinct(), "jaccard-pairs")
        edges = written(self.verified(pairs), "jaccard-links")
        if edges.isEmpty():
            roots = self.spark.createDataFrame([], "node long, root long")
        else:
            roots = components(edges)
        rows = found.where("kind = 1").select("g", F.col("b").alias("s"), "n", "p").join(roots.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("c", F.coalesce("root", "s")).drop("root")
        rows = written(rows, "jaccard-open")
        more = written(_across(rows).join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
        return edges if more.isEmpty() else edges.union(written(self.verified(more), "jaccard-links"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of signatures that link, each compared once. A pivot a meets its members in
        groups of about GROUP, each with its own copy of a's text."""
        short = lambda k: self.reps.select(F.col("s").alias(k), F.col("n").alias("n" + k), F.col("cells").alias("c" + k))
        pairs = pairs.join(short("a"), "a").join(short("b"), "b").mapInPandas(_suffix_filter, "a long, b long")
        pairs = written(pairs, "jaccard-filtered")
        groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("of"))
        salted = pairs.join(groups, "a").select(F.col("a").alias("x"), F.pmod(F.xxhash64("b"), F.col("of")).alias("salt"), F.col("b").alias("member"), F.lit(1).alias("role"))
        members = written(salted.union(salted.select("x", "salt", F.col("x").alias("member"), F.lit(0).alias("role")).distinct()), "jaccard-members")
        fetch = members.join(self.reps.select(F.col("s").alias("member"), "d", "k"), "member")
        null = F.lit("\x00")
        texts = self.docs.select(F.coalesce(F.col("doc_id").cast("string"), null).alias("d"), "k", "text")
        rows = fetch.withColumn("d", F.coalesce("d", null)).join(texts, ["d", "k"]).select("x", "salt", "role", "member", "text")
        return rows.repartition(n_buckets(self.spark, 1), "x", "salt").sortWithinPartitions("x", "salt", "role").mapInPandas(_verify(self.shared), "a long, b long").distinct()


def _roots(join: Join) -> DataFrame:
    """(s, least, root) of every set that isn't empty: least is its smallest doc_id."""
    ids = join.rows.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    links = join.links()
    if links.isEmpty():
        return written(ids.withColumn("root", F.col("s")), "jaccard-roots")
    roots = components(links).select(F.col("node").alias("s"), "root")
    return written(ids.join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "jaccard-roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    component_id is the smallest doc_id among the rows that links reach. Rows of one set are one class
    and meet the join once. A text without words (or null) has an empty set and links with nothing; a
    null id takes part but is never a component_id unless all ids of its component are null; repeated
    rows give a row each; an empty table gives no rows; other columns are never read."""
    join = Join(docs)
    roots = _roots(join)
    best = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(roots.join(best, "root").select("s", "component_id"), "jaccard-ids")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return join.rows.select("doc_id", "s", "n").join(ids, "s", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def best_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when each component keeps one document, that with the smallest id (null
    ids last); texts without words all stay; of repeated rows (same id, same text) one stays. docs may
    have further columns of any name."""
    join = Join(docs)
    roots = _roots(join).select("s", "root")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    best = join.rows.where("n > 0").join(roots, "s").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k")).alias("r"))
    keep = best.select(name(F.col("r.doc_id")).alias("d"), F.col("r.k").alias("k")).union(join.rows.where("n = 0").select(name(F.col("doc_id")), "k")).distinct()
    whole = docs.select(F.struct("*").alias("row"), name(F.col("doc_id")).alias("d"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k"))
    return whole.join(written(keep, "jaccard-keep"), ["d", "k"], "left_semi").dropDuplicates(["d", "k"]).select("row.*")
