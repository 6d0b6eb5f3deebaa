"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one task of a Python stage holds at once.
BUCKET_BYTES = 12 << 20
#: Options of mallopt().
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, M_ARENA_MAX = -1, -3, -8


def return_freed_memory() -> None:
    """From now on this process gives freed blocks of 256 KB and more back to the system.

    By itself the C library raises that bound to 32 MB with use, and Arrow's pool keeps what it had; a Python worker stays
    for the tasks of all stages, and would hold the largest of them beside the one that runs.
    """
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # of the GNU library
        for option, value in ((M_MMAP_THRESHOLD, 256 << 10), (M_TRIM_THRESHOLD, 1 << 20), (M_ARENA_MAX, 1)):
            libc.mallopt(option, value)
        pa.set_memory_pool(pa.system_memory_pool())


if sys.platform == "linux" and "pyspark.worker" in sys.modules:  # this is a Python worker, not the driver
    return_freed_memory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session has none and all runs on one machine (tests, a laptop) is one set, below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one scan of one column, one row to the driver."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def bucket_count(n_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about bucket_bytes each, so that a bucket fits a task at every size of input."""
    return max(1, math.ceil(n_bytes / bucket_bytes))


def row_keys() -> tuple:
    """k1 and k2: a row's identity by doc_id and text together, never null; equal rows share it."""
    return (
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("k2"),
    )


def drop_keys(docs: DataFrame, bad: DataFrame, tag: str, bound: int = 1_000_000, keys: tuple = ()) -> DataFrame:
    """docs without the rows whose keys (those of row_keys(), or other two) are k1, k2 in bad; these are broadcast up to `bound` keys (16 MB), else shuffled."""
    bad = written(bad, tag)
    if bad.limit(bound + 1).count() <= bound:
        bad = F.broadcast(bad)
    keyed = docs.select("*", *(k.alias(f"__{n}") for k, n in zip(keys or row_keys(), ("k1", "k2"))))
    left = keyed.join(bad, (F.col("__k1") == bad.k1) & (F.col("__k2") == bad.k2), "left_anti")
    return left.drop("__k1", "__k2")


def rows_of(names: str, rows: list[tuple]) -> pa.Table:
    """An Arrow table of rows, its columns named and typed as in "a long, b binary"."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [tuple(f.split(" ")) for f in names.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def dealt(rows: DataFrame, bucket: str) -> DataFrame:
    """bucket, packed: the rows of each Arrow batch that go to one bucket, compressed together (texts cross the network so)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            to = batch.column(at).to_numpy()
            order = np.argsort(to, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(order))
            packed = []
            for a, b in zip(cuts, cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as stream:
                    stream.write_batch(batch.take(pa.array(order[a:b])))
                packed.append(press.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(to[order][cuts[:-1]], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    at = rows.columns.index(bucket)
    return rows.mapInArrow(run, "bucket long, packed binary")


def unpacked(bucket: pa.Table) -> pa.Table:
    """The rows of a bucket; a batch at a time is opened."""
    unzip = zstandard.ZstdDecompressor()
    return pa.concat_tables([pa.ipc.open_stream(unzip.decompress(x.as_py())).read_all() for x in bucket["packed"]])
