"""What the corpus operators share: the shared folder, words, hashes and packed exchanges.

Several operators move hashes between documents and a corpus-wide table. They
cut the corpus into *chunks* (some megabytes of whole documents, one row each),
let every chunk send its distinct keys once, packed by hash bucket, and send the
bucket's answers back to the chunk in the same order. Spark partitions and
shuffles the rows; numpy works inside one bounded chunk or bucket.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rank of a missing doc_id: after every other document.
LAST_ID = 2**63 - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch on its way to Python, which the JVM and the worker hold several times over, each for every task.
BATCH_BYTES = 8 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/loomgraph"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes to the shared folder and reads back: cuts the lineage, survives lost executors.

    The shuffle files of the job are let go when it ends, and the table when the driver does.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with _let_go(spark):
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    _at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _let_go(spark: SparkSession):
    """Lets the shuffle files of the jobs inside go when they end, and keeps their batches small."""
    before = {name: spark.conf.get(name, None) for name in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _at_exit(spark: SparkSession, path: str) -> None:
    """Has a path deleted when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """A table in the shared folder, bucketed by a column: grouping by that doesn't exchange it again.

    It is deleted when the driver ends.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "bucketed")
    name = f"loomgraph_{uuid.uuid4().hex}"
    with _let_go(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    _at_exit(spark, path)
    return spark.table(name)


def dropped(df: DataFrame) -> None:
    """Deletes what `written` made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHashes(dict):
    """64-bit hash of a word, kept for the words seen last."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_held: dict[str, list[dict]] = {}


def held(operator: str, cache: dict) -> dict:
    """Makes a cache known as one of an operator's in this worker."""
    _held.setdefault(operator, []).append(cache)
    return cache


def only(operator: str) -> None:
    """Empties what other operators keep in this worker: it serves one stage after another, and their caches would add up."""
    for other, caches in _held.items():
        if other != operator:
            for cache in caches:
                cache.clear()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a missing text is empty. `bytes.split()` cuts at [\\x20\\x09-\\x0D]."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes, by murmur-style finalisation."""
    x = (a * MIX) ^ (b + (a >> np.uint64(31)))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def chunked(docs: DataFrame, chunk_bytes: int, text: str = "text", place: str | None = None) -> tuple[DataFrame, str]:
    """Documents with a chunk number, and that column's name; `place` names a column for their order.

    A chunk is the next documents of a partition with about chunk_bytes of text; a longer
    document is a chunk of its own. The result is written, so that a chunk keeps its
    documents whatever is lost later, and so that its documents lie together.
    """
    name = free_name(docs, "_chunk")
    at = docs.columns.index(text)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size, row, base = 0, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), np.int64) + 1) + size
            size = int(sizes[-1]) if len(sizes) else size
            places = [pa.array(np.arange(row, row + len(b)))] if place else []
            row += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + sizes // chunk_bytes), *places], names=[*b.schema.names, *more])

    more = [name, *filter(None, [place])]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in more)])
    return written(docs.mapInArrow(number, schema), "chunks"), name


def by_chunk(batches: Iterator[pa.RecordBatch], chunk: str) -> Iterator[tuple[int, pa.Table]]:
    """(chunk, its rows) for rows whose chunks lie together."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        ids = np.asarray(b.column(b.schema.get_field_index(chunk)))
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi <= lo:
                continue
            if last is not None and ids[lo] != last:
                yield last, pa.Table.from_batches(kept)
                kept = []
            last = int(ids[lo])
            kept.append(b.slice(lo, hi - lo))
    if kept:
        yield last, pa.Table.from_batches(kept)


def buckets_for(spark: SparkSession, total_keys: float, per_bucket: int = 1_000_000) -> int:
    """Hash buckets of at most about per_bucket keys: as many more as there is more data."""
    return max(partitions(spark), math.ceil(total_keys / per_bucket))


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Start of each bucket in ascending 64-bit keys, and the end; buckets are equal key ranges."""
    step = (1 << 64) // buckets + 1
    edges = np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges, "left"), [len(keys)]])


def packed(chunk: int, keys: np.ndarray, buckets: int, **more: np.ndarray) -> pa.RecordBatch:
    """One row a bucket that has keys: (bucket, chunk, keys, ...), each array as bytes; keys ascend."""
    cuts = bucket_cuts(keys, buckets)
    has = np.flatnonzero(np.diff(cuts))
    part = lambda x: pa.array([blob(x[cuts[i] : cuts[i + 1]]) for i in has], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(has, pa.int64()), pa.array(np.full(len(has), chunk), pa.int64()), part(keys), *(part(x) for x in more.values())],
        names=["bucket", "chunk", "keys", *more],
    )


def unpacked(rows: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the row that each comes from."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in rows.column(column)]
    return np.concatenate([np.zeros(0, kind), *parts]), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def runs_of(*ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in arrays that are ordered together."""
    if not len(ordered[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(ordered[0]), bool)
    new[0] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def blob(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
