"""Media columns: content-addressed payloads in tar shards (operator 1).

Payloads are stored as 8-bit grey PNG images, members of tar shards named by the digest of the stored
form; rows carry digest, shard, offset and length. Metadata columns come from range reads of the first
HEADER bytes of a member alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, written

#: Samples of an image row; payloads are multiples of it.
WIDTH = 576
PAD = b"\xff"
#: A PNG's signature, and the bytes up to the end of its header chunk.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
SHARD_BYTES = 64 << 20
LEVEL = 6


def payload_of(text) -> bytes:
    """UTF-8 of a text (null: nothing), filled with bytes 255 to a positive multiple of WIDTH."""
    raw = text.encode() if isinstance(text, str) else b""
    return raw + PAD * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_png(media: bytes) -> bytes:
    width, height, bits = read_header(media[:HEADER])
    at, body = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are stored")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean sample and a 64-bit average hash over 64 equal stretches of the samples."""
    x = np.frombuffer(payload, np.uint8)
    cuts = np.arange(64) * len(x) // 64
    total = np.add.reduceat(x, cuts, dtype=np.int64)
    size = np.diff(np.r_[cuts, len(x)])
    bits = total * len(x) > int(x.sum(dtype=np.int64)) * size
    return f"{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


@lru_cache(4)
def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


class _Shard:
    """A tar file being written; equal payloads within it are stored once."""

    def __init__(self, folder: str, name: str):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        self.name, self.out, self.size, self.known = name, store.open_output_stream(f"{path}/{name}"), 0, {}

    def put(self, payload: bytes) -> tuple[str, int, int]:
        key = hashlib.sha256(payload).digest()
        if key not in self.known:
            media = encode_png(payload)
            digest = hashlib.sha256(media).hexdigest()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.known[key] = digest, self.size + len(head), len(media)
            body = head + media + bytes(-len(media) % tarfile.BLOCKSIZE)
            self.out.write(body)
            self.size += len(body)
        return self.known[key]

    def close(self) -> None:
        self.out.write(bytes(2 * tarfile.BLOCKSIZE))
        self.out.close()


def _write_shards(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        made, shard = 0, None
        for pdf in batches:
            rows = []
            for text in pdf["t"]:
                if shard is None or shard.size >= SHARD_BYTES:
                    if shard is not None:
                        shard.close()
                    shard, made = _Shard(folder, f"{task.partitionId():06d}-{task.taskAttemptId()}-{made}.tar"), made + 1
                digest, offset, length = shard.put(payload_of(text))
                rows.append((shard.name, digest, offset, length))
            out = pd.DataFrame(rows, columns=["shard", "digest", "offset", "length"])
            out.insert(0, "d", pdf["d"].to_numpy())
            yield out
        if shard is not None:
            shard.close()

    return run


def store(docs: DataFrame) -> tuple[DataFrame, str]:
    """(index, folder): doc_id, shard, digest, offset, length for every row of docs(doc_id, text).

    Shards lie in the shared folder, each named by its task attempt, so a repeated task writes its own
    and the index only names those of attempts that finished. No text is shuffled: equal payloads are
    stored once a shard, and any row's address holds the bytes of its digest."""
    bounded_batches(docs.sparkSession)
    folder = new_path(docs.sparkSession, "media")
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("d"), F.col("text").alias("t")).mapInPandas(_write_shards(folder), "d string, shard string, digest string, offset long, length long")
    return written(rows.select(F.col("d").cast(kind).alias("doc_id"), "shard", "digest", "offset", "length"), "media-index"), folder


def _read(folder: str, whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _store(folder)
        opened, name = None, None
        for pdf in batches:
            rows = []
            for shard, digest, offset, length in zip(pdf["shard"], pdf["digest"], pdf["offset"], pdf["length"]):
                if shard != name:
                    if opened is not None:
                        opened.close()
                    opened, name = fs.open_input_file(f"{path}/{shard}"), shard
                head = opened.read_at(HEADER, offset)
                width, height, bits = read_header(head)
                row = (width, height, bits)
                if whole:
                    media = head + opened.read_at(length - HEADER, offset + HEADER)
                    found = hashlib.sha256(media).hexdigest()
                    if found != digest:
                        raise ValueError(f"{shard} at {offset}: the bytes don't bear out their digest")
                    payload = decode_png(media)
                    row += (len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), found, feature_of(payload))
                rows.append(row)
            cols = ["width", "height", "bits", *["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] * whole]
            yield pd.concat([pdf[["d"]].reset_index(drop=True), pd.DataFrame(rows, columns=cols)], axis=1)
        if opened is not None:
            opened.close()

    return run


_META = "width int, height int, bits int"
_FULL = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _reading(index: DataFrame, folder: str, whole: bool) -> DataFrame:
    kind = index.schema["doc_id"].dataType
    rows = index.select(F.col("doc_id").cast("string").alias("d"), "shard", "digest", "offset", "length")
    return rows.mapInPandas(_read(folder, whole), f"d string, {_META}" + f", {_FULL}" * whole).withColumn("d", F.col("d").cast(kind)).withColumnRenamed("d", "doc_id")


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, width, height, bits: HEADER bytes a row are read, nothing else."""
    return _reading(index, folder, False)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every row's payload, read it back, compute its features.

    One row for each row of docs, nulls included (null text counts as empty, a payload of WIDTH bytes
    255); equal texts give equal values; other columns of docs are never read; an empty table gives no
    rows. n_bytes counts up to the filling, which UTF-8 can't end with."""
    index, folder = store(docs)
    return _reading(index, folder, True).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def listing(folder: str, shard: str) -> list[tuple[str, int]]:
    """Members of a shard, as any tar reader sees them."""
    fs, path = _store(folder)
    with fs.open_input_file(f"{path}/{shard}") as f:
        return [(m.name, m.size) for m in tarfile.open(fileobj=io.BytesIO(f.read())).getmembers()]
