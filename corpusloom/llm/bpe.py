"""BPE encoding and decoding over a table of distinct words (operator 7)."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, n_buckets, new_path, publish, release_shuffles, written
from .media import _store

#: A batch of documents shares one local dictionary; it ends at so many words or distinct words.
BATCH_WORDS, BATCH_DISTINCT = 8_000_000, 600_000
#: A row of packed documents ends at so many words or documents.
ROW_WORDS, ROW_DOCS = 200_000, 2_000
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the
    others numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def pieces(path: str) -> tuple[bytes, ...]:
    """The bytes of every id: the id-to-piece table, bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    table = {i: bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return tuple(table.get(i, b"") for i in range(max(table) + 1))


@lru_cache(2)
def _splitter(path: str):
    """text -> its pieces as the tokenizer splits them. The regex module takes texts of Latin letters,
    where its letter and digit classes are the tokenizer's; any other text goes through the tokenizer's
    own splitter. Added tokens are cut out first and stay whole."""
    import regex

    find, other = regex.compile(PATTERN).findall, regex.compile("[^\x00-ɏ‐-‧€]").search
    t = _tokenizer(path)
    own = t.pre_tokenizer
    with open(path, encoding="utf-8") as f:
        added = [a["content"] for a in json.load(f)["added_tokens"]]
    cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def plain(text: str) -> list[str]:
        if other(text):
            at, out = 0, []
            for _, (a, b) in own.pre_tokenize_str(text):
                assert a == at
                out.append(text[a:b])
                at = b
            return out
        return find(text)

    def split(text: str) -> list[str]:
        if cut is None or not any(a in text for a in added):
            return plain(text)
        return [w for k, part in enumerate(cut.split(text)) for w in ([part] if k % 2 else plain(part))]

    return split


def _pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    import zstandard

    return zstandard.compress(b"".join([np.array([len(arrays), *[len(a.tobytes()) for a in arrays]], np.uint64).tobytes(), *[a.tobytes() for a in arrays]]), level)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.uint64, len(types), 8).astype(int)
    at, out = 8 * (1 + len(types)), []
    for n, kind in zip(sizes, types):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _varint(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 28 in 1 to 4 bytes, seven bits each, the top bit marking that more follow."""
    n = 1 + (x >= 1 << 7).astype(np.int64) + (x >= 1 << 14) + (x >= 1 << 21)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(4):
        has = n > k
        out[at[has] + k] = (x[has] >> (7 * k)) & 127 | np.where(n[has] > k + 1, 128, 0)
    return out


def _unvarint(b: np.ndarray) -> np.ndarray:
    last = b < 128
    end = np.flatnonzero(last)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    out = np.zeros(len(end), np.uint32)
    for k in range(4):
        has = end - start >= k
        out[has] |= (b[start[has] + k] & 127).astype(np.uint32) << np.uint32(7 * k)
    return out


def _split_words(path: str, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, part, number = _splitter(path), TaskContext.get().partitionId(), 0
        local: dict[str, int] = {}
        words = pending = 0

        def dictionary(batch: int) -> pd.DataFrame:
            raw = [w.encode() for w in local]
            bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                own = order[cuts[k] : cuts[k + 1]]
                if len(own):
                    chosen = [raw[i] for i in own]
                    rows.append((batch, k, _pack(np.diff(own, prepend=0).astype(np.uint32), np.array([len(w) for w in chosen], np.uint32), np.frombuffer(b"".join(chosen), np.uint8))))
            return pd.DataFrame(rows, columns=["batch", "wb", "blob"]).assign(ids=None)

        held: list[tuple[str | None, np.ndarray]] = []

        def documents(batch: int) -> pd.DataFrame:
            blob = _pack(_varint(np.concatenate([x for _, x in held])), np.array([len(x) for _, x in held], np.uint32), level=7)
            out = pd.DataFrame({"batch": [batch], "wb": [-1], "blob": [blob], "ids": [[i for i, _ in held]]})
            held.clear()
            return out

        for pdf in batches:
            for doc_id, text in zip(pdf["d"], pdf["text"]):
                found = split(text) if isinstance(text, str) and text else []
                held.append((doc_id, np.array([local.setdefault(w, len(local)) for w in found], np.uint32)))
                words, pending = words + len(found), pending + len(found)
                full = words >= BATCH_WORDS or len(local) >= BATCH_DISTINCT
                if full or pending >= ROW_WORDS or len(held) >= ROW_DOCS:
                    yield documents(part * 1_000_000 + number)
                    pending = 0
                if full:
                    yield dictionary(part * 1_000_000 + number)
                    words, number = 0, number + 1
                    local.clear()
        if held:
            yield documents(part * 1_000_000 + number)
        if local:
            yield dictionary(part * 1_000_000 + number)

    return run


def _encode_bucket(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = _tokenizer(path)
        seen: dict[bytes, int] = {}
        uses = []
        for batch, blob in zip(pdf["batch"], pdf["blob"]):
            gaps, lengths, raw = _unpack(blob, np.uint32, np.uint32, np.uint8)
            ends, whole = np.cumsum(lengths, dtype=np.int64), raw.tobytes()
            words = [whole[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
            uses.append((batch, gaps, np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)))
        distinct, ids = list(seen), []
        for k in range(0, len(distinct), 20_000):
            ids += [np.array(e.ids, np.uint32) for e in t.encode_batch([w.decode() for w in distinct[k : k + 20_000]], add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.uint32)
        return pd.DataFrame([(batch, _pack(gaps, count[own], np.concatenate([ids[i] for i in own]))) for batch, gaps, own in uses], columns=["batch", "codes"])

    return run


def _write_dictionary(folder: str):
    """The codes of a batch's words, in the order of their local numbers, as one file of the batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        parts = [_unpack(x, np.uint32, np.uint32, np.uint32) for x in pdf["codes"]]
        local = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts])
        counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
        codes = np.concatenate([p[2] for p in parts])
        order = np.argsort(local)
        first = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        codes = codes[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(codes))]
        batch = int(pdf["batch"].iloc[0])
        temp = f"{path}/.{batch}-{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(temp) as out:
            out.write(_pack(n.astype(np.uint32), codes))
        publish(store, temp, f"{path}/{batch}")
        return pd.DataFrame({"batch": [batch], "n_words": [len(n)]})

    return run


def _dictionary(folder: str, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes a word, where they begin, codes) of a batch; a batch of empty texts has none."""
    store, path = _store(folder)
    if store.get_file_info(f"{path}/{batch}").size is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
    with store.open_input_file(f"{path}/{batch}") as f:
        n, codes = _unpack(f.read(), np.uint32, np.uint32)
    n = n.astype(np.int64)
    return n, np.cumsum(n) - n, codes


def coded(docs: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """(packed documents, folder of the batches' dictionaries): the two sides of the join by position.

    Every distinct word of the corpus is encoded once, in the bucket of its checksum; only a batch's
    distinct words travel, so a frequent word costs one entry a batch. The codes come back as one file a
    batch in the shared folder, so the packed documents, the larger side, never move."""
    path = path or default_tokenizer()
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = n_buckets(spark, 2)
    rows = docs.select(F.col("doc_id").cast("string").alias("d"), "text")
    split = written(rows.mapInPandas(_split_words(path, buckets), "batch long, wb int, blob binary, ids array<string>"), "bpe-words")
    ids = split.where("wb >= 0").select("batch", "wb", "blob").groupBy("wb").applyInPandas(_encode_bucket(path), "batch long, codes binary")
    folder = new_path(spark, "bpe-dictionaries")
    written(ids.groupBy("batch").applyInPandas(_write_dictionary(folder), "batch long, n_words long"), "bpe-batches")
    release_shuffles(spark)
    return split.where("wb < 0").select("batch", "ids", "blob"), folder


def decoded_ids(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """Lists of (doc_id as text, ids) from packed documents."""
    now, n, first, codes = None, None, None, None
    for pdf in batches:
        for batch, names, blob in zip(pdf["batch"], pdf["ids"], pdf["blob"]):
            if batch != now:
                now, (n, first, codes) = batch, _dictionary(folder, batch)
            numbers, sizes = _unpack(blob, np.uint8, np.uint32)
            index, out, at = _unvarint(numbers).astype(np.int64), [], 0
            for doc_id, size in zip(names, sizes.tolist()):
                own = index[at : at + size]
                at += size
                k = n[own]
                out.append((doc_id, codes[np.repeat(first[own] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] if size else codes[:0]))
            yield out


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text).

    Decoding is the id-to-piece join: every id is looked up in the vocabulary, whose size is fixed and which
    each worker holds, so that no id travels. Null text counts as empty
    (0 tokens, hashes of nothing); added tokens in a text get their own ids; repeated rows and null ids
    give a row each; an empty table gives no rows; other columns are never read."""
    path = path or default_tokenizer()
    words, folder = coded(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pieces(path)
        names = [str(i) for i in range(len(table))]
        for documents in decoded_ids(folder, batches):
            rows = []
            for doc_id, x in documents:
                x = x.tolist()
                text = b"".join([table[i] for i in x]).decode("utf-8", "replace").encode()
                rows.append((doc_id, len(x), hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pd.DataFrame(rows, columns=["d", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = words.mapInPandas(run, "d string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.select(F.col("d").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
