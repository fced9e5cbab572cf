"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of q distinct five-word shingles counts as contained in a document that has at
least THRESHOLD of them. Items are partitioned by size (powers of two). An item's sketch is
its m smallest shingle hashes, m = floor((1 - THRESHOLD) q) + 1: as a document may lack at
most m - 1 of the item's shingles, it must have one of any m, so one shared sketch hash is
both necessary and sure to be seen. As sketches are minima, a document looks up only its
hashes below the partition's largest sketch hash. Candidates are verified by exact shingle
containment over the whole document. An item of fewer than five words has one shingle of all
its words; documents' runs of words are hashed at just the lengths that such items have.

The benchmark is used in blocks of at most BLOCK_SHINGLES hashes, each broadcast; more
items make more passes over the documents. Documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import MIX, WordHashes, held, only, texts, written

THRESHOLD, SHINGLE, BLOCK_SHINGLES = 0.8, 5, 2_000_000
#: ASCII characters other than letters and digits part words; A-Z count as a-z.
FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()
_cache = held("op06", WordHashes(5))


def hashed(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, one after another, and how many words each text has."""
    only("op06")
    words = [t.translate(FOLD).split() for t in batch]
    return _cache.of([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64)


def runs(h: np.ndarray, sizes: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of `length` words of each text, one after another, and where each text starts."""
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    n = max(0, len(h) - length + 1)
    s = np.zeros(n, np.uint64)
    for i in range(length):
        s = s * MIX + h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    inside = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return s[inside], np.concatenate([[0], np.cumsum(counts)])


def prepared(items: DataFrame, short: bool, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, q, hashes, length): distinct shingle hashes of each item, ascending, and their words. Items without words are left out, and those of fewer than five unless short."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, sizes = hashed(texts(b.column(1)))
            lengths = np.minimum(sizes, SHINGLE)
            own = [np.zeros(0, np.uint64)] * len(sizes)
            for n in set(lengths.tolist()) - {0}:
                s, at = runs(h, sizes, n)
                for i in np.flatnonzero(lengths == n).tolist():
                    own[i] = np.unique(s[at[i] : at[i + 1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(o) for o in own], pa.int64()), pa.array([o.tobytes() for o in own], pa.binary()), pa.array(lengths)], names=["item_id", "q", "hashes", "length"])

    chosen = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(work, "item_id bigint, q bigint, hashes binary, length bigint").where(f"q > 0 AND length >= {1 if short else SHINGLE}")


class Index:
    """Sketches of a block of items, by size partition, and the items' shingles."""

    def __init__(self, rows: list[tuple[int, int, bytes, int]]):
        self.ids = [r[0] for r in rows]
        self.own = [np.frombuffer(r[2], np.uint64) for r in rows]
        parts: dict[int, list[int]] = {}
        short: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if r[3] < SHINGLE:
                short.setdefault(r[3], []).append(i)
                continue
            parts.setdefault(r[1].bit_length(), []).append(i)
        self.parts, self.short = [], []
        for length, members in sorted(short.items()):
            keys = np.concatenate([self.own[i] for i in members])
            order = np.argsort(keys, kind="stable")
            self.short.append((length, keys[order], np.array(members)[order]))
        for number, members in sorted(parts.items()):
            sketches = [self.own[i][: math.floor((1 - THRESHOLD) * len(self.own[i]) + 1e-9) + 1] for i in members]
            keys = np.concatenate(sketches)
            owner = np.repeat(members, [len(k) for k in sketches])
            order = np.argsort(keys, kind="stable")
            self.parts.append((1 << number - 1, keys[order], owner[order]))

    def found(self, batch: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) for every item that a text contains."""
        h, sizes = hashed(batch)
        yield from self.search(*runs(h, sizes))
        for length, keys, owner in self.short:
            s, at = runs(h, sizes, length)
            i = np.flatnonzero(np.isin(s, keys))
            which = np.searchsorted(at, i, "right") - 1
            lo, hi = np.searchsorted(keys, s[i], "left"), np.searchsorted(keys, s[i], "right")
            yield from ((k, item, 1) for k, item in sorted({(k, item) for k, a, b in zip(which.tolist(), lo.tolist(), hi.tolist()) for item in owner[a:b].tolist()}))

    def search(self, s: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) for the texts whose shingles are s, cut at `at`."""
        which = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found: set[tuple[int, int]] = set()
        for least, keys, owner in self.parts:
            few = np.diff(at) < math.ceil(THRESHOLD * least - 1e-9)  # too short for any item of the partition
            i = np.flatnonzero((s <= keys[-1]) & ~few[which])
            i = i[np.isin(s[i], keys)]
            lo, hi = np.searchsorted(keys, s[i], "left"), np.searchsorted(keys, s[i], "right")
            for k, a, b in zip(which[i].tolist(), lo.tolist(), hi.tolist()):
                found.update((k, item) for item in owner[a:b].tolist())
        for k, item in sorted(found):
            shared = int(np.isin(self.own[item], s[at[k] : at[k + 1]]).sum())
            if shared >= THRESHOLD * len(self.own[item]) - 1e-9:
                yield k, item, shared


def blocks(items: DataFrame, short: bool) -> Iterator[Index]:
    """The items in blocks of at most BLOCK_SHINGLES shingles, or of one item."""
    table = written(prepared(items, short), "items")
    n = max(1, math.ceil((table.agg(F.sum("q")).first()[0] or 0) / BLOCK_SHINGLES))
    number = lambda n: F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n))
    while n > 1 and table.groupBy(number(n).alias("b")).agg(F.sum("q").alias("q"), F.count("*").alias("n")).where(f"q > {BLOCK_SHINGLES} AND n > 1").limit(1).count():
        n *= 2
    for b in range(n):
        rows = [tuple(r) for r in table.where(number(n) == b).select("item_id", "q", "hashes", "length").collect()]
        if rows:
            yield Index(rows)


def _parts(b: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for i in range(0, len(b), 400):
        part = b.slice(i, 400)
        yield part, texts(part.column(at))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", short: bool = False) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every item that a document contains.

    Null or wordless texts contain nothing; items under five words are searched whole if short, else not; repeated
    rows of either side each give their own rows; a null doc_id or item_id stays null. Empty
    tables give no rows. Other columns aren't read.
    """
    schema = "doc_id bigint, item_id bigint, item_shingles bigint, shared bigint, containment double"
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in blocks(items, short):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                for part, own in _parts(b, 1):
                    rows = list(index.found(own))
                    k, item, shared = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
                    q = np.array([len(index.own[i]) for i in item], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(k)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(q), pa.array(shared), pa.array(shared / q if len(q) else q.astype(float))],
                        names=["doc_id", "item_id", "item_shingles", "shared", "containment"],
                    )

        found = chosen.mapInArrow(work, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", short: bool = False) -> DataFrame:
    """The documents that contain no item, of fewer than five words only if short; all columns and repeats stay."""
    at = docs.columns.index(text)
    for index in blocks(items, short):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, own in _parts(b, at):
                    keep = np.ones(len(part), bool)
                    keep[[k for k, _, _ in sent.value.found(own)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


#: The same matches in DuckDB SQL, but for items of fewer than five words, which it leaves out.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY 1)
SELECT ds.doc_id, bs.item_id, max(q.q) AS item_shingles, count(*) AS shared, count(*) / max(q.q) AS containment
FROM ds JOIN bs USING (s) JOIN q ON q.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id HAVING count(*) >= 0.8 * max(q.q)
"""
