"""SimHash near-duplicates: a byte-position inverted index with count filtering, whose tally is the index itself.

The shared bytes of a pair aren't counted one by one, a departure from the method. Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8
positional bytes: that is the guaranteed minimum of the count filter. A pair that
has the minimum shares the posting of some 5 positions, so the index is kept by
(5 positions, their bytes), 56 postings a fingerprint, and being met in one *is*
the tally. A posting's fingerprints differ in 24 known bits only: it can't hold
more than 2^24 distinct ones however large the corpus is. Within a posting,
candidates are verified in numpy and only links that join two groups are kept,
so that no posting emits all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import free_name, only, partitions, texts, written
from loomgraph.llm.components import components, shared_join

DISTANCE, SHINGLE, SEED = 3, 3, 42
POSITIONS = list(combinations(range(8), 8 - DISTANCE))
#: Distinct fingerprints up to which a posting is compared pair by pair, in blocks.
PAIRWISE = 4096


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the shingles of SHINGLE lower-cased words, repeats counted."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64, len(starts))
    else:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    counts, n = np.zeros(64, np.int64), len(h)
    for i in range(0, n, 8192):
        counts += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer. A null text has no words: zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op09")
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id bigint, fp bigint")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """56 rows a distinct fingerprint: (key, fp); key has the positions' number and 40 bits."""
    for b in batches:
        fp = np.asarray(b.column(0)).view(np.uint64)
        by = fp.view(np.uint8).reshape(-1, 8)
        for number, at in enumerate(POSITIONS):
            key = np.zeros((len(fp), 8), np.uint8)
            key[:, : len(at)] = by[:, at]
            key[:, 7] = number
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), b.column(0)], names=["key", "fp"])


def _near(fp: np.ndarray, flips: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ascending distinct fingerprints within DISTANCE bits, one posting's."""
    n, left, right = len(fp), [], []
    if n <= PAIRWISE:
        step = max(1, 1_000_000 // n)
        for i in range(0, n, step):
            a, b = np.nonzero(np.bitwise_count(fp[i : i + step, None] ^ fp[None, :]) <= DISTANCE)
            keep = a + i < b
            left.append(a[keep] + i)
            right.append(b[keep])
    else:  # look up each of the neighbours that can differ: as many for any size of posting
        for flip in flips:
            other = fp ^ flip
            at = np.minimum(np.searchsorted(fp, other), n - 1)
            i = np.nonzero((fp[at] == other) & (fp < other))[0]
            left.append(i)
            right.append(at[i])
    return np.concatenate(left), np.concatenate(right)


def _flips(number: int) -> np.ndarray:
    bits = [np.uint64(1) << np.uint64(8 * p + b) for p in range(8) if p not in POSITIONS[number] for b in range(8)]
    return np.array([np.bitwise_or.reduce(c) for k in range(1, DISTANCE + 1) for c in combinations(bits, k)], np.uint64)


def _joining(n: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Numbers of the pairs that join two groups: a spanning forest."""
    up, kept = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return kept


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the postings in one partition, which come whole and in order."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for last, b in _marked(batches):
        if b is not None:
            key, fp = np.concatenate([key, np.asarray(b.column(0))]), np.concatenate([fp, np.asarray(b.column(1))])
        if not len(key):
            continue
        cut = len(key) if last else int(np.searchsorted(key, key[-1], "left"))  # the last posting may go on
        starts = np.flatnonzero(np.concatenate([[True], key[1:cut] != key[: cut - 1]])) if cut else np.zeros(0, np.int64)
        ends = np.append(starts[1:], cut)
        many = np.flatnonzero(ends - starts > 1)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            own = np.sort(fp[s:e].view(np.uint64))
            a, c = _near(own, _flips(int(key[s : s + 1].view(np.uint8)[7])) if e - s > PAIRWISE else None)
            if len(a):
                k = _joining(len(own), a, c)
                out.append((own[a[k]].view(np.int64), own[c[k]].view(np.int64)))
        a, c = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], names=["a", "b"])
        key, fp = key[cut:], fp[cut:]


def _marked(batches):
    for b in batches:
        yield False, b
    yield True, None


def link(fps: DataFrame) -> DataFrame:
    """(fp, fp_root) joins: a spanning set of links (a, b) between distinct fingerprints of `fp`."""
    distinct = fps.select("fp").where("fp IS NOT NULL").distinct()
    n = 4 * partitions(fps.sparkSession)
    postings = distinct.mapInArrow(_postings, "key bigint, fp bigint").repartition(n, "key").sortWithinPartitions("key")
    return postings.mapInArrow(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most 3 bits, itself
    included. Null or wordless texts have fingerprint zero, linked like any other. A null
    doc_id keeps its row; it is the component only where no other doc_id is in it. Repeated
    rows are kept. An empty table gives no rows. Other columns aren't read.
    """
    fps = written(fingerprints(docs, doc_id, text), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link(first))
    of = first.join(roots, first.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = shared_join(of, least.withColumnRenamed("root", "top"), "root", "top", "fp").select(F.col("fp").alias("of"), "component_id")
    return fps.join(ids, fps.fp == ids.of).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest doc_id stays.

    All columns are kept. Rows with a null doc_id stay only where their component has no
    other; of rows that repeat a doc_id, one with the smallest hash of its text stays: whole
    repeats are equal, so which of them doesn't matter but for other columns.
    """
    groups = near_duplicates(docs)
    mine, key = free_name(docs, "_kept"), free_name(docs, "_text_hash")
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(mine)).distinct()
    left = docs.join(kept, docs.doc_id.eqNullSafe(kept[mine]), "left_semi")
    repeated = left.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias(key), F.count("*").alias(mine)).where(F.col(mine) > 1).select(F.col("doc_id").alias(mine), key)
    single = left.join(repeated, left.doc_id.eqNullSafe(repeated[mine]), "left_anti")
    chosen = left.join(repeated, left.doc_id.eqNullSafe(repeated[mine]) & (F.xxhash64("text") == F.col(key)), "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(chosen)
