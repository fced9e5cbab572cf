"""Token ids as flat unsigned integer files with 64-bit document offsets.

A set of files holds documents in ascending doc_id order. Each part has
`part-N.ids` (ids one after another, 16 bits if the vocabulary allows, else 32,
little-endian), `part-N.offsets` (64-bit, one more than documents, in ids from the
part's start) and `part-N.docs` (64-bit doc_id). A part's global start is the
prefix sum of the parts before it; the manifest has it. Readers memory-map parts.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LAST_ID, held, only, partitions, shared_path, texts, written

CACHED, CACHED_LENGTH, MARKS = 1_000_000, 64, b".,;:!?#$%&*|"


class WordEncoder:
    """Ids of texts by the tokenizers library, word by word.

    The vocabulary's pre-tokenisation drops white space and never joins across it, its
    normalisation lowers letters and doesn't reach across white space either, so a text's ids
    are those of its lowered words in order. A letter and the marks after it are never in one
    pre-token, so trailing marks are encoded apart. Words that repeat are looked up.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kept: dict[bytes, bytes] = {}

    def encode(self, batch: list[bytes], end: int) -> list[bytes]:
        """Ids of each text and the end id, little-endian."""
        # special tokens are matched as written, before letters are lowered
        words = [(t if b"<|" in t else t.lower()).split() for t in batch]
        for w in list(islice(self.kept, len(self.kept) // 2)) if len(self.kept) > CACHED else ():  # the older half goes
            del self.kept[w]
        kept, last = self.kept, array("I" if self.wide else "H", [end]).tobytes()
        new = set().union(*words).difference(kept)
        cut = {w: len(base) for w in new if len(base := w.rstrip(MARKS)) < len(w) and base[-1:].isalpha()}
        plain = list(new.difference(cut).union([w[:n] for w, n in cut.items()], [w[n:] for w, n in cut.items()]).difference(kept))
        kept |= zip(plain, self._ids([w.decode() for w in plain]))
        kept |= {w: kept[w[:n]] + kept[w[n:]] for w, n in cut.items()}
        out = [b"".join(map(kept.__getitem__, w)) + last for w in words]
        for w in {*plain, *cut}:
            if len(w) > CACHED_LENGTH:
                del kept[w]
        return out

    def _ids(self, words: list[str]) -> list[bytes]:
        kind, out = "I" if self.wide else "H", []
        for i in range(0, len(words), 5000):
            out += [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words[i : i + 5000], add_special_tokens=False)]
        return out


_loaded: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    only("op04")
    if path not in _loaded:
        encoder = _loaded[path] = WordEncoder(path)
        held("op04", encoder.kept)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids) of each text; a null text is empty, a null doc_id stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.slice(at, 2000)
                ids = encoder.encode(texts(part.column(1)), end)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, ids binary")


def _store(folder: str):
    """A pyarrow file system and the path on it."""
    from pyarrow import fs

    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(folder)


def write_files(ids: DataFrame, folder: str, width: int) -> DataFrame:
    """Writes (doc_id, ids) as a set of files; returns the manifest, one row a part.

    Rows are dealt by ranges of doc_id, a null doc_id last, equal ones ordered by their ids.
    A part written twice, by a repeated or speculative task, is the same file, put in place
    by a rename.
    """
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    dealt = ids.withColumn("_at", order).repartitionByRange(partitions(ids.sparkSession), "_at").sortWithinPartitions("_at", "ids").drop("_at")
    schema = "part int, n_docs bigint, n_tokens bigint, path string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, mark = f"{base}/part-{part:06d}", uuid.uuid4().hex
        offsets, total, count = [np.zeros(1, "<u8")], 0, 0
        with store.open_output_stream(f"{name}.ids.{mark}") as out, store.open_output_stream(f"{name}.docs.{mark}") as docs:
            for b in batches:
                sizes = np.asarray(pa.compute.binary_length(b.column(1)), dtype=np.uint64) // np.uint64(width)
                offsets.append((np.cumsum(sizes) + np.uint64(total)).astype("<u8"))
                total, count = total + int(sizes.sum()), count + len(b)
                for x in b.column(1):
                    out.write(x.as_buffer())
                docs.write(np.asarray(pa.compute.fill_null(b.column(0), LAST_ID)).astype("<i8").tobytes())
        with store.open_output_stream(f"{name}.offsets.{mark}") as out:
            for x in offsets:
                out.write(x.tobytes())
        for kind in ("ids", "docs", "offsets"):
            store.move(f"{name}.{kind}.{mark}", f"{name}.{kind}")
        if count:
            yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": count, "n_tokens": total, "path": name}], pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("path", pa.string())]))

    parts = written(dealt.mapInArrow(write, schema), "manifest")
    # one row a part: as many as shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint"))


def read_files(manifest: DataFrame, folder: str, width: int) -> DataFrame:
    """Per document, from the memory-mapped files: doc_id, start, n_tokens, ids_crc32."""
    kind = "<u2" if width == 2 else "<u4"
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"

    def mapped(store, path: str, dtype: str) -> np.ndarray:
        if store.type_name == "local":
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for row in b.to_pylist():
                ids, docs, offsets = (mapped(store, f"{row['path']}.{k}", d) for k, d in (("ids", kind), ("docs", "<i8"), ("offsets", "<u8")))
                for lo in range(0, row["n_docs"], 4096):
                    hi = min(lo + 4096, row["n_docs"])
                    at = offsets[lo : hi + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1], at[1:])]
                    which = np.asarray(docs[lo:hi])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which, pa.int64(), mask=which == LAST_ID), pa.array(at[:-1] + row["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return manifest.repartition(partitions(manifest.sparkSession), "part").mapInArrow(read, schema)


def token_files(docs: DataFrame, path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Encodes every whole text, appends `end`, writes the files, and reads them back.

    Null texts are empty (the end id alone), null doc_ids come last, repeated rows are kept,
    an empty table gives no rows, other columns aren't read.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    width = 4 if loaded(path).wide else 2
    ids = written(encode_texts(docs, path, end), "ids")
    return read_files(write_files(ids, folder, width), folder, width)
