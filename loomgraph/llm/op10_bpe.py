"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

Each leaf of the tree is an adjacent pair, keyed by (merge rank, position); the
root is thus the leftmost pair of lowest rank. A merge changes three leaves, each
in logarithmic time, until the root is no mergeable pair. Pre-tokens repeat, so a
worker keeps the ids of those it has seen lately; the trees of the short ones that
are new are worked on together, a row each.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import held, only

#: Fixed value: the public byte-level pre-tokenisation pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No pair, larger than any key.
NONE = 1 << 62
SPACE = re.compile(r" (?=\S)")
#: A space that doesn't begin a pre-token with what follows it.
ODD = re.compile(r" (?:\s|\Z)")
#: Marks that are no letters, digits or white space: after letters, a pre-token of their own.
MARKS = ".,;:!?#$%&*|\")"
CACHED, CACHED_LENGTH = 300_000, 64
#: Leaves up to which pre-tokens are merged in numpy together, leaves of a block of them, and characters encoded at once.
TOGETHER, BLOCK, AT_ONCE = 128, 1 << 19, 4_000_000


def tree_size(n: int) -> int:
    """Leaves of the tree for n tokens: the power of two that holds their n - 1 pairs."""
    return 1 << max(n - 2, 0).bit_length()


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [vocab[letters[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(vocab[a] << 20 | vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {pair: rank for rank, (pair, _) in enumerate(merges)}
        self.joined = [into for _, into in merges]
        by_pair = sorted(self.rank.items())
        self.pairs, self.pair_rank = (np.array(x or [-1], np.int64) for x in ([p for p, _ in by_pair], [r for _, r in by_pair]))
        self.first_ids, self.joined_ids, self.none = np.array(self.first), np.array(self.joined or [0]), len(merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.split = regex.compile(PATTERN).findall
        self.tokens: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; `self.none` where there is no such merge."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], self.none)

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes, by the segment tree.

        Leaf i is the pair of the tokens that start at byte i and after it. A merge at i
        changes the leaves of the token before (h), of i, and of the token taken in (j);
        their ancestors are recomputed together, level by level.
        """
        ids, n = [self.first[b] for b in data], len(data)
        if n < 2:
            return ids
        rank, size, shift = self.rank.get, tree_size(n), n.bit_length()
        tree = [NONE] * size
        tree += [r << shift | i if (r := rank(ids[i] << 20 | ids[i + 1])) is not None else NONE for i in range(n - 1)]
        tree += [NONE] * (2 * size - len(tree))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before, mask = list(range(1, n + 1)), list(range(-1, n)), (1 << shift) - 1
        while (top := tree[1]) != NONE:
            i = top & mask
            j = after[i]
            own, ids[j] = self.joined[top >> shift], -1
            ids[i] = own
            k = after[i] = after[j]
            lo, hi = i + size, min(j, n - 2) + size
            tree[hi] = NONE
            if k < n:
                before[k] = i
                r = rank(own << 20 | ids[k])
                tree[lo] = NONE if r is None else r << shift | i
            else:
                tree[lo] = NONE
            h = before[i]
            if h >= 0:
                r = rank(ids[h] << 20 | own)
                lo = h + size
                tree[lo] = NONE if r is None else r << shift | h
            while lo > 1:
                lo, hi = lo >> 1, hi >> 1
                for p in range(lo, hi + 1):
                    a, b = tree[p + p], tree[p + p + 1]
                    tree[p] = a if a < b else b
        return [i for i in ids if i >= 0]

    def merged_together(self, words: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pre-tokens of 2 to size + 1 bytes: one segment tree of `size` leaves a row.

        The steps are those of `merged`, each taken by every row that still has a mergeable pair.
        """
        count, width, shift = len(words), size + 2, size.bit_length() + 1
        lengths = np.fromiter(map(len, words), np.int64, count)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((count, width), -1, np.int64)
        ids[inside] = self.first_ids[np.frombuffer(b"".join(words), np.uint8)]
        place = np.arange(size)
        leaf = np.where(place + 1 < lengths[:, None], self.ranks(ids[:, :size], ids[:, 1 : size + 1]), self.none)
        tree = np.full((count, 2 * size), NONE, np.int64)
        tree[:, size:] = np.where(leaf == self.none, NONE, leaf << shift | place)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, width + 1), (count, 1))
        before = np.tile(np.arange(-1, width - 1), (count, 1))
        tree, ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        rows = np.arange(count)
        while True:
            top = tree[rows * (2 * size) + 1]
            going = top != NONE
            rows, top = rows[going], top[going]
            if not len(rows):
                break
            at, root, n = rows * width, rows * (2 * size), lengths[rows]
            i = top & ((1 << shift) - 1)
            j = after[at + i]
            k = after[at + j]
            own = self.joined_ids[top >> shift]
            ids[at + i], ids[at + j] = own, -1
            after[at + i], before[at + np.minimum(k, width - 1)] = k, i
            j = np.minimum(j, size - 1)
            tree[root + size + j] = NONE
            r = np.where(k < n, self.ranks(own, ids[at + np.minimum(k, width - 1)]), self.none)
            tree[root + size + i] = np.where(r == self.none, NONE, r << shift | i)
            h = before[at + i]
            has = h >= 0
            h = np.where(has, h, i)
            r = self.ranks(ids[at + h], own)
            tree[root + size + h] = np.where(has, np.where(r == self.none, NONE, r << shift | h), tree[root + size + h])
            nodes = [size + j, size + i, size + h]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[root + x] = np.minimum(tree[root + 2 * x], tree[root + 2 * x + 1])
        left = ids >= 0
        ends = np.cumsum(left.reshape(count, width).sum(axis=1)) * 4
        packed = ids[left].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merged_all(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each pre-token: short ones by their trees' size together, long ones alone."""
        got: dict[str, bytes] = {}
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            if 2 <= len(data) <= TOGETHER + 1:
                sized.setdefault(tree_size(len(data)), []).append((word, data))
            else:
                ids = self.merged(data)
                got[word] = struct.pack(f"<{len(ids)}I", *ids)
        for size, members in sized.items():
            step = max(1, BLOCK // size)
            for lo in range(0, len(members), step):
                names, data = zip(*members[lo : lo + step])
                got.update(zip(names, self.merged_together(list(data), size)))
        return got

    def cut_part(self, part: str) -> list[str]:
        """Pre-tokens of a space and a part; letters, and marks after letters, need no pattern."""
        if part.isalpha():
            return [" " + part]
        letters = part.rstrip(MARKS)
        return [" " + letters, part[len(letters) :]] if letters.isalpha() else self.split(" " + part)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers; special tokens in it count as such.

        A space before a character that is no white space always begins a pre-token, so texts
        are cut there first. Parts not seen lately are cut into pre-tokens, and the pre-tokens
        not seen lately are merged together.
        """
        plans: list[list] = []  # ids of a special token, or the pre-tokens that begin a piece and the parts after spaces
        parts, tokens = self.parts, self.tokens
        begins: list[list[str]] = []
        rests: list[list[str]] = []
        for text in texts:
            plan: list = []
            for piece in self.cut.split(text) if self.cut and any(map(text.__contains__, self.special)) else [text]:
                if piece in self.special:
                    plan.append(self.special[piece].to_bytes(4, "little"))
                elif piece:
                    begin, *rest = SPACE.split(piece) if ODD.search(piece) else piece.split(" ")
                    begins.append(self.split(begin)), rests.append(rest)
                    plan.append((begins[-1], rest))
            plans.append(plan)
        new = list(set().union(*rests).difference(parts))
        cut = list(map(self.cut_part, new))
        missing = list(set().union(*begins, *cut).difference(tokens))
        tokens.update(self.merged_all(missing))
        parts.update(zip(new, (b"".join(map(tokens.__getitem__, words)) for words in cut)))
        out = []
        for plan in plans:
            row = [step if isinstance(step, bytes) else b"".join(map(tokens.__getitem__, step[0])) + b"".join(map(parts.__getitem__, step[1])) for step in plan]
            out.append(b"".join(row))
        for kept, more in ((tokens, missing), (parts, new)):
            for w in more:
                if len(w) > CACHED_LENGTH:
                    del kept[w]
            for w in list(islice(kept, len(kept) - CACHED // 2)) if len(kept) > CACHED else ():  # the older half goes
                del kept[w]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the ids' text; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I")))
        return data.decode("utf-8", "replace").encode()


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary a worker and path."""
    only("op10")
    if path not in _loaded:
        bpe = _loaded[path] = Bpe(path)
        held("op10", bpe.tokens), held("op10", bpe.parts)
    return _loaded[path]


def at_once(column: pa.Array) -> Iterator[list[str]]:
    """A column's texts, in lists of about AT_ONCE characters; a missing text is empty."""
    part, size = [], 0
    for x in column:
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text (little-endian 32-bit binary). A null text is encoded as empty.

    Rows, repeats and other columns stay as they are; a column named `ids` is replaced.
    """
    kept = docs.drop(ids)
    at = kept.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            got = pa.array([x for part in at_once(b.column(at)) for x in bpe.encode_all(part)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, ids])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null ids decode to an empty text. A column named `text` is replaced."""
    kept = df.drop(text)
    at = kept.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            got = pa.array([bpe.decode(x or b"") for x in b.column(at).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, text])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())]))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number and SHA-256 of the ids of its text, and SHA-256 of the decoded text.

    The ids are those of `encode`, the decoded text that of `decode`, in one pass, so that
    ids and texts needn't travel. Null text: empty. Null doc_id and repeated rows: kept.
    An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for part in at_once(b.column(1)):
                for ids in bpe.encode_all(part):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
