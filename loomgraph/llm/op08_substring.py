"""Substring de-duplication by recompression.

The words of all documents are parsed in rounds. A round first replaces each run of
one symbol by a symbol for (symbol, length), then each pair (x, y) where x falls left
and y right of the round's split of the alphabet by a symbol for the pair. Names are
64-bit hashes of what they stand for, so every task of every round gives the same
name to the same run or pair without a dictionary: names are global by construction.

Which words decide a symbol's existence is tracked exactly (its *scope*: its own words
and those of the neighbours that could have changed it). So two equal word sequences
have the same symbols wherever the scope lies inside. A window that holds the scope of a
symbol which no second document has can't repeat. All other windows are candidates, and
are verified as a whole by 128-bit hashes: the smallest doc_id in which each starts.

Spark's rounds: (1) which sampled high-level symbols occur in several chunks, (2) the
smallest doc_id of each candidate window, (3) the removal. Each round sends distinct
keys of a chunk, packed by hash bucket, and sends answers back to the chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import LAST_ID, MIX, WordHashes, blob, buckets_for, by_chunk, chunked, dropped, free_name, held, mixed, only, packed, runs_of, texts, unpacked, written

WINDOW, ROUNDS, CHUNK_BYTES = 50, 3, 4_000_000
#: One symbol of SAMPLE, by its name, is sent; windows without one are candidates.
SAMPLE_BITS = 2
RUN, SPLIT = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_hashes = held("op08", WordHashes(1))


def word_hashes(words: list[bytes]) -> np.ndarray:
    only("op08")
    return _hashes.of(words)


class Words:
    """The words of a chunk's documents, one after another."""

    def __init__(self, rows: list[bytes], ids: np.ndarray):
        self.words = [t.split() for t in rows]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(rows)), sizes)
        self.ids = ids
        flat = [w for ws in self.words for w in ws]
        self.a = word_hashes(flat)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128-bit hashes of the windows, as two 64-bit ones, and where each starts."""
        n = len(self.a)
        if n < WINDOW:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        b = mixed(self.a, np.full(1, SPLIT))
        at = np.flatnonzero(self.doc[: n - WINDOW + 1] == self.doc[WINDOW - 1 :])
        return rolled(self.a, MIX | np.uint64(1), at), rolled(b, RUN | np.uint64(1), at), at


def rolled(h: np.ndarray, base: np.uint64, at: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2^64, of the WINDOW hashes from each place in `at`.

    From prefix sums of h[i] * base^i, shifted back by powers of the inverse of the odd base.
    """
    powers = lambda x: np.cumprod(np.append(np.uint64(1), np.full(len(h), x, np.uint64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base)[:-1])])
    return (sums[at + WINDOW] - sums[at]) * powers(np.uint64(pow(int(base), -1, 1 << 64)))[at]


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """High-level symbols: name, scope from, scope to, and document.

    A scope that reaches over a document's edge ends outside the document.
    """
    s, doc = words.a, words.doc
    lo = np.arange(len(s), dtype=np.int64)
    hi = lo + 1
    first, last = words.starts[:-1] - 1, words.starts[1:] + 1
    for level in range(ROUNDS):
        if not len(s):
            break
        at = runs_of(s, doc)
        size = np.diff(np.append(at, len(s))).astype(np.uint64)
        end = np.append(at[1:], len(s)) - 1
        lo, hi = around(lo, hi, doc, at, end, first, last)
        s = np.where(size > 1, mixed(s[at] ^ RUN, size), s[at])
        doc = doc[at]
        right = mixed(s, np.full(1, SPLIT + np.uint64(level))) >> np.uint64(63) == 1
        same = doc[1:] == doc[:-1]
        pair = np.append(~right[:-1] & right[1:] & same, False)
        second = np.concatenate([[False], pair[:-1]])
        i = np.arange(len(s))
        before, after = np.maximum(i - 1, 0), np.minimum(i + 1, len(s) - 1)
        starts, ends = np.concatenate([[True], ~same]), np.append(~same, True)
        low = np.where(right, np.where(starts, first[doc], np.minimum(lo, lo[before])), lo)
        high = np.where(~right | pair, np.where(ends, last[doc], np.maximum(hi, hi[after])), hi)
        s = np.where(pair, mixed(s, s[after]), s)
        keep = ~second
        s, doc, lo, hi = s[keep], doc[keep], low[keep], high[keep]
    return s, lo, hi, doc


def around(lo, hi, doc, at, end, first, last) -> tuple[np.ndarray, np.ndarray]:
    """Scopes of runs: with the symbols before and after, which show where the run ends."""
    n = len(lo)
    before, after = np.maximum(at - 1, 0), np.minimum(end + 1, n - 1)
    own = doc[at]
    low = np.where((at > 0) & (doc[before] == own), np.minimum(lo[before], lo[at]), first[own])
    high = np.where((end < n - 1) & (doc[after] == own), np.maximum(hi[after], hi[end]), last[own])
    return low, high


def sampled(words: Words):
    """Symbols that are sent: those of the sample whose scope fits a window of the document."""
    s, lo, hi, doc = symbols(words)
    keep = (mixed(s, np.full(1, MIX)) >> np.uint64(64 - SAMPLE_BITS) == 0) & (hi - lo <= WINDOW)
    keep &= (lo >= words.starts[doc]) & (hi <= words.starts[doc + 1])
    return s[keep], lo[keep], hi[keep], doc[keep]


def _read(rows: pa.Table, doc_id: str, text: str) -> Words:
    ids = rows.column(doc_id).combine_chunks().fill_null(LAST_ID)
    return Words([x for c in rows.column(text).chunks for x in texts(c)], np.asarray(ids, np.int64))


def _shared(key, rows):
    """A bucket's names that several chunks have, for each of these chunks."""
    keys, row = unpacked(rows, "keys", np.uint64)
    order = np.argsort(keys, kind="stable")
    start = runs_of(keys[order])
    many = np.repeat(np.diff(np.append(start, len(keys))) > 1, np.diff(np.append(start, len(keys))))
    hit = np.zeros(len(keys), bool)
    hit[order] = many
    return _answers(rows, row, hit, keys=keys)


def _answers(rows: pa.Table, row: np.ndarray, hit: np.ndarray, **values: np.ndarray) -> pa.Table:
    """A row for each asking chunk with the values that are hits."""
    chunks = np.asarray(rows.column("chunk"))
    cut = np.searchsorted(row[hit], np.arange(len(chunks) + 1))
    has = np.flatnonzero(np.diff(cut))
    own = {k: v[hit] for k, v in values.items()}
    return pa.table({"chunk": pa.array(chunks[has], pa.int64())} | {k: pa.array([blob(v[cut[i] : cut[i + 1]]) for i in has], pa.binary()) for k, v in own.items()})


def _least(key, rows):
    """A bucket's windows that some document with a smaller doc_id has, for each asking chunk."""
    a, row = unpacked(rows, "keys", np.uint64)
    b, ids, most = (unpacked(rows, c, t)[0] for c, t in (("second", np.uint64), ("least", np.int64), ("most", np.int64)))
    order = np.lexsort((b, a))
    start = runs_of(a[order], b[order])
    size = np.diff(np.append(start, len(a)))
    least = np.zeros(len(a), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], start), size) if len(a) else least
    hit = (least < ids) | (least < most)
    return _answers(rows, row, hit, keys=a, second=b, least=least)


def _asked(words: Words, chunk: int, shared: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The chunk's candidate windows: 128-bit hash, smallest and largest doc_id in the chunk."""
    s, lo, hi, doc = sampled(words)
    order = np.lexsort((doc, s))
    start = runs_of(s[order])
    several = np.zeros(len(s), bool)
    if len(s):
        d = doc[order]
        several[order] = np.repeat(np.maximum.reduceat(d, start) > np.minimum.reduceat(d, start), np.diff(np.append(start, len(s))))
    single = ~(several | np.isin(s, shared))
    n = len(words.a)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, np.maximum(hi[single] - WINDOW, words.starts[doc[single]]), 1)
    np.add.at(cover, lo[single] + 1, -1)
    dead = np.cumsum(cover)[:n] > 0
    a, b, at = words.windows()
    keep = ~dead[at]
    a, b, ids = a[keep], b[keep], words.ids[words.doc[at[keep]]]
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    start = runs_of(a, b)
    end = np.append(start[1:], len(a))[: len(start)] - 1
    return packed(chunk, a[start], buckets, second=b[start], least=ids[start], most=ids[end])


def removed(words: Words, answers: pa.Table) -> np.ndarray:
    """Which words are covered by a window that starts in a document with a smaller doc_id."""
    n = len(words.a)
    cover = np.zeros(n + 1, np.int32)
    a, b, at = words.windows()
    ka, kb, least = (unpacked(answers, c, t)[0] for c, t in (("keys", np.uint64), ("second", np.uint64), ("least", np.int64)))
    if len(ka) and len(a):
        order = np.lexsort((kb, ka))
        ka, kb, least = ka[order], kb[order], least[order]
        first = runs_of(ka, kb)
        ka, kb, least = ka[first], kb[first], least[first]
        i = np.minimum(np.searchsorted(ka, a), len(ka) - 1)
        for _ in range(4):  # two windows may share the first half of the hash
            step = (ka[i] == a) & (kb[i] != b) & (i + 1 < len(ka))
            i = np.where(step, np.minimum(i + 1, len(ka) - 1), i)
        hit = (ka[i] == a) & (kb[i] == b) & (least[i] < words.ids[words.doc[at]])
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + WINDOW, -1)
    return np.cumsum(cover)[:n] > 0


def _rounds(docs: DataFrame, doc_id: str, text: str, finish: Callable, schema) -> DataFrame:
    spark = docs.sparkSession
    table, chunk = chunked(docs, CHUNK_BYTES, text)
    words = table.select(F.sum(F.length(text) / 6)).first()[0] or 0
    n_symbols, n_windows = buckets_for(spark, words / 8), buckets_for(spark, words / 3)
    slim = table.select(F.col(chunk), F.col(doc_id).cast("bigint").alias(doc_id), text)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_chunk(batches, chunk):
            yield packed(number, np.unique(sampled(_read(rows, doc_id, text))[0]), n_symbols)

    def windows(key, rows, shared):
        return pa.Table.from_batches([_asked(_read(rows, doc_id, text), key[0].as_py(), unpacked(shared, "keys", np.uint64)[0], n_windows)] if len(rows) else [], ASKED)

    shared = written(slim.mapInArrow(names, "bucket bigint, chunk bigint, keys binary").groupBy("bucket").applyInArrow(_shared, "chunk bigint, keys binary"), "symbols")
    asked = slim.groupBy(chunk).cogroup(shared.groupBy("chunk")).applyInArrow(windows, "bucket bigint, chunk bigint, keys binary, second binary, least binary, most binary")
    least = written(asked.groupBy("bucket").applyInArrow(_least, "chunk bigint, keys binary, second binary, least binary"), "windows")
    dropped(shared)

    def end(key, rows, answers):
        rows = rows.drop_columns([chunk])
        own = Words([x for c in rows.column(text).chunks for x in texts(c)], np.asarray(rows.column(doc_id).combine_chunks().cast(pa.int64()).fill_null(LAST_ID)))
        return finish(rows, own, removed(own, answers))

    return table.groupBy(chunk).cogroup(least.groupBy("chunk")).applyInArrow(end, schema)


ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("second", pa.binary()), ("least", pa.binary()), ("most", pa.binary())])


def _kept(words: Words, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """For each document: its words, those removed, and the text of the rest."""
    for i, own in enumerate(words.words):
        cut = gone[words.starts[i] : words.starts[i + 1]]
        k = int(cut.sum())
        yield len(own), k, b" ".join(own if not k else [w for w, g in zip(own, cut) if not g])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256.

    A word is removed if a window of 50 consecutive words over it also starts in a document
    with a smaller doc_id. Null texts have no words. A null doc_id counts as larger than any
    other; rows with equal doc_ids don't remove each other's words. An empty table: no rows.
    Other columns aren't read.
    """

    def finish(rows: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        found = [(n, k, hashlib.sha256(t).hexdigest()) for n, k, t in _kept(words, gone)]
        n, k, sha = zip(*found) if found else ((), (), ())
        return pa.table({"doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(k, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _rounds(docs.select("doc_id", "text"), "doc_id", "text", finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated words removed; a text that loses none stays as it was.

    Other columns stay; a text that loses words has the kept ones joined by one space.
    """
    schema, at = docs.schema, docs.columns.index(text)

    def finish(rows: pa.Table, words: Words, gone: np.ndarray) -> pa.Table:
        was = rows.column(at).to_pylist()
        new = [old if not k else t.decode() for old, (_, k, t) in zip(was, _kept(words, gone))]
        return rows.set_column(at, rows.schema.field(at), pa.array(new, pa.string()))

    return _rounds(docs, doc_id, text, finish, schema)
