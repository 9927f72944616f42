"""Token ids as binary shards in training order (operator 8).

Documents are dealt to streams by a hash of id and text and ordered within them by that hash, so that
sequences depend on the documents alone and not on how the table is split. Streams are cut into sequences
of one length; a keyed Feistel permutation gives every sequence a global slot; shards hold consecutive
slots at a fixed stride, so a reader finds any slot by arithmetic, reads on sequentially and resumes
anywhere.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, new_path, publish, release_shuffles, written
from .media import _store

LENGTH, ROUNDS = 2048, 6
#: Sequences in a shard, and in a row of the table of sequences.
SHARD, BLOCK = 8_192, 256
END = 50256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network over the least even number of bits
    that holds n, walked along its cycle until the value falls below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "big")) for r in range(ROUNDS)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for k in keys:
                f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            out[todo] = left << np.uint64(half) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _sequences(path: str, length: int):
    """Each stream's documents, an end token after each, cut into sequences; the last is filled with end
    tokens, its count of real ones is kept. BLOCK sequences make a row. Streams come one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        encode = _encoding(path).encode_ordinary
        end, size = np.array([END], "<u2"), length * BLOCK
        held: list[np.ndarray] = []
        now, count, index = None, 0, 0

        def row(ids: np.ndarray) -> pd.DataFrame:
            n = -(-len(ids) // length)
            whole = np.full(n * length, END, "<u2")
            whole[: len(ids)] = ids
            return pd.DataFrame({"stream": [now], "i": [index], "n": [n], "n_tokens": [len(ids)], "blob": [zstandard.compress(whole.tobytes(), 9)]})

        for pdf in batches:
            for stream, text in zip(pdf["stream"], pdf["text"]):
                if stream != now:
                    if count:
                        yield row(np.concatenate(held))
                    now, held, count, index = stream, [], 0, 0
                ids = np.array(encode(text), "<u2") if isinstance(text, str) and text else end[:0]
                held += [ids, end]
                count += len(ids) + 1
                while count >= size:
                    ids = np.concatenate(held)
                    yield row(ids[:size])
                    held, count, index = [ids[size:]], len(ids) - size, index + BLOCK
        if count:
            yield row(np.concatenate(held))

    return run


def _slots(n: int, key: int, starts, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        stride = 2 * length
        for pdf in batches:
            for stream, i, k, tokens, blob in zip(pdf["stream"], pdf["i"], pdf["n"], pdf["n_tokens"], pdf["blob"]):
                raw = zstandard.decompress(blob)
                slot = feistel(starts.value[stream] + i + np.arange(k), n, key)
                own = np.minimum(tokens - np.arange(k) * length, length)
                yield pd.DataFrame({"shard": slot // SHARD, "slot": slot, "n_tokens": own, "body": [zstandard.compress(raw[a * stride : (a + 1) * stride], 3) for a in range(k)]})

    return run


def _write(folder: str, per_shard: int, stride: int):
    """Rows sorted by shard and slot -> shard files, written under a name of the attempt and then moved:
    a file of the final name is whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, now, temp = None, None, ""

        def done() -> None:
            if out is not None:
                out.close()
                publish(store, temp, f"{path}/{now:08d}.bin")

        for pdf in batches:
            for shard, slot, body in zip(pdf["shard"], pdf["slot"], pdf["body"]):
                if shard != now:
                    done()
                    now, temp, at = shard, f"{path}/.{shard}-{attempt}", shard * per_shard
                    out = store.open_output_stream(temp)
                raw = zstandard.decompress(body)
                if slot != at or len(raw) != stride:
                    raise ValueError(f"slot {slot} where {at} is due")
                out.write(raw)
                at += 1
            yield pd.DataFrame({"shard": pdf["shard"], "slot": pdf["slot"], "offset": (pdf["slot"] - pdf["shard"] * per_shard) * stride, "n_tokens": pdf["n_tokens"]})
        done()

    return run


def streamed(docs: DataFrame) -> DataFrame:
    """(h, d, text, stream) of docs(doc_id, text): documents dealt to about as many streams as a stream has
    documents, by a hash of id and text; equal rows are interchangeable."""
    n = max(1, math.isqrt(docs.select("doc_id").count()))
    d = F.col("doc_id").cast("string")
    h = F.xxhash64(F.coalesce(d, F.lit("\x00")), F.coalesce(F.col("text"), F.lit("")))
    return docs.select(h.alias("h"), d.alias("d"), "text").withColumn("stream", F.pmod("h", F.lit(n)).cast("int"))


def materialise(docs: DataFrame, key: int = 20240607, path: str | None = None, length: int = LENGTH) -> tuple[DataFrame, str]:
    """(index, folder): slot, shard, offset, n_tokens of every sequence, and the folder of shards
    00000000.bin, 00000001.bin, ... of SHARD sequences of length 16-bit ids each (the last may be
    shorter). n_tokens counts ids before the filling.

    Global numbers are those of the streams' sequences one after the other, from the counts of streams
    (one number a stream, the root of the number of documents, goes to the driver); the order of training
    is the permutation's alone. The same documents give the same shards, however the table is split. Null
    and empty texts give one end token; repeated rows are repeated; an empty table gives no rows and no
    shards; other columns are never read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # nothing holds on to the shuffled texts, so that their files may go before the shards are written
    cut = written(
        streamed(docs).repartitionById(tasks, F.col("stream")).sortWithinPartitions("stream", "h", "d", "text").select("stream", "text")
        .mapInPandas(_sequences(path or default_ranks(), length), "stream int, i long, n int, n_tokens long, blob binary"), "token-sequences",
    )
    starts, total = {}, 0
    for r in cut.groupBy("stream").agg(F.sum("n").alias("n")).orderBy("stream").collect():
        starts[r["stream"]], total = total, total + r["n"]
    release_shuffles(spark)
    folder = new_path(spark, "token-shards")
    sent = spark.sparkContext.broadcast(starts)
    slots = cut.mapInPandas(_slots(total, key, sent, length), "shard long, slot long, n_tokens int, body binary")
    rows = slots.repartitionById(-(-total // SHARD) or 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")
    index = written(rows.mapInPandas(_write(folder, SHARD, 2 * length), "shard long, slot long, offset long, n_tokens int"), "token-index")
    drop_written(cut)
    release_shuffles(spark)
    return index, folder


def read_back(index: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """slot, shard, offset, n_tokens, sha256 of each sequence's bytes as they lie in the shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        opened, name = None, None
        for pdf in batches:
            out = []
            for shard, offset in zip(pdf["shard"], pdf["offset"]):
                if shard != name:
                    opened, name = store.open_input_file(f"{path}/{shard:08d}.bin"), shard
                out.append(hashlib.sha256(opened.read_at(2 * length, offset)).hexdigest())
            yield pdf.assign(sha256=out)

    return index.select("slot", "shard", "offset", "n_tokens").mapInPandas(run, "slot long, shard long, offset long, n_tokens int, sha256 string")
