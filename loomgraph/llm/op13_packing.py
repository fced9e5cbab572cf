"""Best-fit packing of token ids into sequences of equal capacity, in bulk.

Documents are cut into pieces of at most the capacity, and the pieces are ranked by
length: a piece's rank among those of its length comes from prefix sums over the tasks
that cut them. Gaps are runs of sequences with equal room, kept in order of room. Lengths
take their turns, longest first, and all pieces of a length go in one step: they sweep
over the gaps from the smallest that holds them (their successor) upwards, new sequences
come last; which piece of a length gets which gap is settled by rank; the gaps that were
used move to the room they have left, and the next length follows. As a gap that took
all it could of a length can't take another one of it, this equals sequential best-fit
decreasing, sequence by sequence. Steps and runs are bounded by the capacity, whatever
the number of documents; every piece looks its place up by (length, rank) where it lies.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import only, written
from loomgraph.llm.op10_bpe import PATTERN, at_once, byte_letters

#: Bits of a rank in the key that places are looked up by.
RANK_BITS = 48


class Encoder:
    """Ids of whole texts as the tokenizers library has them, from its JSON file.

    Plain byte-level BPE whose ids ascend with the merges is what tiktoken does, a few times
    faster: a pair's rank is the id that it makes. Other vocabularies go to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", []))
        made = [vocab[a + b] for a, b in merges]
        split = spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain = plain and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"]) and not spec["model"].get("ignore_merges")
        if plain and made == sorted(set(made)):
            import tiktoken

            back = {letter: byte for byte, letter in byte_letters().items()}
            ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in added}
            self.fast, self.library = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added), None
        else:
            from tokenizers import Tokenizer

            self.fast, self.library = None, Tokenizer.from_file(path)
            self.library.no_truncation(), self.library.no_padding()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids; a special token in the text counts as such."""
        if self.fast is None:
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            ids = self.fast.encode_to_numpy(text, allowed_special="all")
        return ids.astype("<u4").tobytes()


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One vocabulary a worker and path."""
    only("op13")
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, end: int, capacity: int = 1024) -> DataFrame:
    """The pieces of every text's ids and the end id, written.

    (doc_id, piece, start, length, ids, task, nth): ids are little-endian 32-bit, start
    counts the document's ids before the piece, nth the task's pieces of the same length
    before it. All pieces but a document's first have the full capacity. A null text is empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, task = encoder(path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        last = end.to_bytes(4, "little")
        for b in batches:
            at = 0
            for part in at_once(b.column(1)):
                which, piece, start, length, cut = [], [], [], [], []
                for row, text in enumerate(part, at):
                    ids = ids_of(text) + last
                    n = len(ids) // 4
                    bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    which += [row] * (len(bounds) - 1)
                    piece += range(len(bounds) - 1)
                    start += bounds[:-1]
                    length += [y - x for x, y in zip(bounds[:-1], bounds[1:])]
                    cut += [ids[4 * x : 4 * y] for x, y in zip(bounds[:-1], bounds[1:])]
                at += len(part)
                nth = np.zeros(len(length), np.int64)
                sizes = np.array(length)
                for size in np.unique(sizes):
                    same = sizes == size
                    nth[same] = seen[size] + np.arange(same.sum())
                    seen[size] += same.sum()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(cut, pa.binary()), pa.array([task] * len(cut), pa.int64()), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids", "task", "nth"],
                )

    return written(docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, piece int, start bigint, length bigint, ids binary, task bigint, nth bigint"), "pieces")


def places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over lengths and their counts: rows (length, rank, sequence, each, offset).

    Pieces of a length, from `rank` up to the next row's, go into consecutive sequences from
    `sequence` on, `each` of them one after another from `offset`.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    rooms: list[int] = []
    made, out = 0, []

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                free(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer pieces than the next gap could take
                out.append((length, rank, first, left, capacity - room))
                free(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            free(room, first, n)
    return np.array(out, np.int64).reshape(-1, 5)


def packed(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to what `pieces` gives (or some of its columns); task and nth go.

    Sequences are gapless from offset 0 and are numbered from 0. Repeated rows and null
    doc_ids are pieces like any other; no pieces give no rows.
    """
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a length: at most `capacity`
    table = places({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    keys = table[:, 0] << RANK_BITS | table[:, 1]
    ranked = cut.join(base, ["task", "length"]).select(*[c for c in cut.columns if c not in ("task", "nth")], (F.col("base") + F.col("nth")).alias("rank"))
    fields = T.StructType([*ranked.drop("rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(at_length)), np.asarray(b.column(at_rank))
            row = table[np.searchsorted(keys, length << RANK_BITS | rank, "right") - 1]
            nth = rank - row[:, 1]
            kept = [c for i, c in enumerate(b.columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=fields.names)

    keys, table = keys[order := np.argsort(keys)], table[order]
    return ranked.mapInArrow(place, fields)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of each sequence: its pieces' ids in order of their offsets, at most `capacity` of them."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(inside, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def digest(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """Per piece of every whole text: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, path, end, capacity)
    return packed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
