"""Results kept by what they were made of: a table is computed once for the same inputs and parameters."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _fs


def digest(df: DataFrame) -> str:
    """A digest of a table's schema and rows, in any order: count, and sums of two hashes of each row. Maps count
    as their sorted entries."""
    cols = [F.sort_array(F.map_entries(F.col(f"`{f.name}`"))) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema]
    nulls = F.concat_ws("", *[F.col(f"`{f.name}`").isNull().cast("string") for f in df.schema])  # a hash passes over nulls
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), nulls, *cols).cast("decimal(38,0)"))
    r = df.agg(F.count("*"), total(1), total(2)).first()
    return hashlib.sha256(f"{df.schema.json()}|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest()


def key(tag: str, inputs: dict[str, DataFrame], parameters: dict | None = None, version: str = "") -> str:
    """The name of a result: its tag and a digest of the inputs, the parameters (what JSON can say) and the
    version of the code that makes it."""
    made_of = json.dumps([{n: digest(df) for n, df in sorted(inputs.items())}, parameters or {}, version], sort_keys=True)
    return f"{tag}_{hashlib.sha256(made_of.encode()).hexdigest()[:32]}"


def cached(spark: SparkSession, root: str, tag: str, inputs: dict[str, DataFrame], compute: Callable[[], DataFrame], parameters: dict | None = None, version: str = "") -> DataFrame:
    """The table that compute() makes of the inputs: read from root if it is there, else computed, written under
    a name of its own and moved into place. Of two writers at once the first one's table stays, which holds the
    same rows; a stopped writer leaves nothing under the result's name."""
    final = f"{root.rstrip('/')}/{key(tag, inputs, parameters, version)}"
    fs, to = _fs(spark, final)
    if not fs.exists(_fs(spark, f"{final}/_SUCCESS")[1]):
        temp = f"{root.rstrip('/')}/_{tag}-{uuid.uuid4().hex}"
        compute().write.parquet(temp)
        own = _fs(spark, temp)[1]
        if fs.exists(to) or not fs.rename(own, to) or fs.exists(_fs(spark, f"{final}/{own.getName()}")[1]):
            fs.delete(_fs(spark, f"{final}/{own.getName()}")[1], True)  # a rename onto a folder moves into it
            fs.delete(own, True)
    return spark.read.parquet(final)


def pruned(spark: SparkSession, root: str, tag: str, keep: str) -> int:
    """Remove the results of a tag but that of name keep; how many went. Not while others may read them."""
    fs, p = _fs(spark, root)
    old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith(f"{tag}_") and x.getPath().getName() != keep]
    for path in old:
        fs.delete(path, True)
    return len(old)
