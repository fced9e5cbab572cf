"""LM scoring: a Katz backoff model over words, of any order.

P(w | h) is d(c) c / c(h) for an n-gram seen c times, d being its order's Good-Turing
discount of its count, and alpha(h) P(w | h') for one not seen, h' being h without its first
word and alpha exactly what makes P(. | h) sum to 1; after a history never seen, alpha is 1.
P(w) is (c + DELTA) / (N + DELTA (V + 1)), with one share for all unknown words. A history
of order n is the n - 1 words before, less where the document begins; its end is a token.

The corpus becomes a table of chunks once: a row has some megabytes of documents as places in
the chunk's own list of words. It is bucketed by chunk, so that later passes don't exchange
it. Counting and scoring share one exchange: every chunk sends its distinct n-grams of an
order with their local counts, packed by hash bucket; a bucket sums them, names one owner for
each, and answers the chunks where more than one has it, by the key's place in what they sent.
What isn't answered is the chunk's alone. An n-gram whose history or whose last n - 1 words are
the chunk's alone can't be elsewhere, so it isn't sent. The answers are a table partitioned by
the n-gram's order. Then, order by order, as a lower-order mass needs the weights below it: from
the n-grams that it owns, a chunk sums each history's discounts and lower-order mass; buckets add them up to backoff weights where other
chunks have the history, too, and answer those that a token in the chunk backs off from. A
history's count is that of itself as an n-gram, as a token always follows it. At last each
chunk scores its documents token by token through all orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import WordHashes, bucket_cuts, bucketed, buckets_for, held, mixed, only, partitions, runs_of, texts, written

DELTA, TOP, CHUNK_BYTES = 0.1, 5, 6_000_000
#: Unit of the lower-order mass above bigrams: whole numbers, so that sums don't hang on their order.
UNIT = 2.0**48
BEGIN, END = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)
_cache = held("op03", WordHashes(3))
_ZSTD = pa.Codec("zstd")
CHUNK = "chunk bigint, doc_ids array<bigint>, held binary, sizes binary, words binary, places binary, n bigint"
SENT = "kind int, bucket int, chunk bigint, keys binary, counts binary, stats binary"
ANSWER = "kind int, chunk bigint, bucket int, places binary, counts binary, own binary, alpha binary, stats array<bigint>"
TOLD = ("kind", "chunk", "bucket", "places", "counts", "own", "alpha")
SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.rsplit(" ", 1) for f in ddl.split(", "))])


def pack(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + (_ZSTD.compress(np.ascontiguousarray(x), asbytes=True) if len(x) else b"")


def unpack(b: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(_ZSTD.decompress(b[8:], n * np.dtype(kind).itemsize), kind) if n else np.zeros(0, kind)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of x by value, the starts of its runs there, and each element's run."""
    order = np.argsort(x)
    start = runs_of(x[order])
    step = np.zeros(len(x), np.int32)
    step[start[1:]] = 1
    run = np.empty(len(x), np.int32)
    run[order] = np.cumsum(step, dtype=np.int32)
    return order, start, run


def chunk_row(number: int, ids: list, held: list[bool], rows: list[bytes]) -> pa.RecordBatch:
    """A chunk's documents: the hashes of its distinct words and of the end, and each token's place among them."""
    words = [t.lower().split() for t in rows]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes)
    token = np.empty(int(ends[-1]), np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[ends - 1] = False
    only("op03")
    token[is_word] = _cache.of([w for ws in words for w in ws])
    token[ends - 1] = END
    order, start, place = grouped(token)
    row = {"chunk": number, "doc_ids": ids, "held": pack(np.array(held, bool)), "sizes": pack(sizes), "words": token[order[start]].tobytes(), "places": pack(place), "n": len(token)}
    return pa.RecordBatch.from_pylist([row], _arrow(CHUNK))


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of CHUNK from (doc_id, text, held_out): the next documents of a partition with about CHUNK_BYTES of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        kept: tuple[list, list, list] = [], [], []
        for b in batches:
            for one in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts(b.column(1))):
                for part, x in zip(kept, one):
                    part.append(x)
                size += len(one[2]) + 1
                if size >= CHUNK_BYTES:
                    yield chunk_row(number, *kept)
                    kept, number, size = ([], [], []), number + 1, 0
        if kept[0]:
            yield chunk_row(number, *kept)

    return docs.mapInArrow(work, CHUNK)


class Level:
    """A chunk's distinct n-grams of one order: by token their place, and by n-gram its key, history, count and first token."""

    def __init__(self, at: np.ndarray, keys: np.ndarray, count: np.ndarray, first: np.ndarray, hist: np.ndarray | None = None, of: np.ndarray | None = None):
        self.at, self.keys, self.count, self.first, self.hist, self.of = at, keys, count, first, hist, of
        self.total, self.own = count.astype(np.uint64), count > 0
        self.shared = np.zeros(len(keys), bool)


class Chunk:
    """The levels of one row of CHUNK, each built from the one below."""

    def __init__(self, row: dict):
        self.sizes, self.held = unpack(row["sizes"], np.int64), unpack(row["held"], bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(~self.held, self.sizes).astype(np.uint32)
        at, keys = unpack(row["places"], np.int32), np.frombuffer(row["words"], np.uint64)
        first = np.empty(len(keys), np.int64)
        first[at] = np.arange(len(at))
        self.level = {1: Level(at, keys, np.bincount(at, self.learn, len(keys)).astype(np.uint32), first)}

    def grow(self, k: int) -> Level:
        """The level of order k: its n-grams lie by history, so that a history's lie together."""
        low, words = self.level[k - 1], self.level[1]
        hist = np.empty(len(low.at), np.int32)
        hist[1:] = low.at[:-1]
        hist[self.starts] = len(low.keys)
        order, start, at = grouped(hist.astype(np.int64) * len(words.keys) + words.at)
        first = order[start]
        of = hist[first]
        keys = mixed(np.append(low.keys, BEGIN)[of], words.keys[words.at[first]])
        self.level[k] = Level(at, keys, np.add.reduceat(self.learn[order], start, dtype=np.uint32), first, hist, of)
        return self.level[k]

    def sent(self, k: int) -> np.ndarray:
        """The n-grams of order k that other chunks may have, by key: all up to pairs, else those whose both parts they have."""
        level = self.level[k]
        if k <= 2:
            return np.argsort(level.keys)
        low = self.level[k - 1]
        may = np.flatnonzero(np.append(low.shared, True)[level.of] & low.shared[low.at[level.first]])
        return may[np.argsort(level.keys[may])]

    def hear(self, k: int, answers: pa.Table, buckets: int) -> None:
        """Whole counts and owners of the n-grams of order k that other chunks have, too."""
        level, mine = self.level[k], self.sent(k)
        cuts = bucket_cuts(level.keys[mine], buckets)
        for r in answers.filter(pc.equal(answers.column("kind"), k)).select(["bucket", "places", "counts", "own"]).to_pylist():
            at = mine[cuts[r["bucket"]] + np.cumsum(unpack(r["places"], np.uint32).astype(np.int64))]
            level.total[at], level.own[at], level.shared[at] = unpack(r["counts"], np.uint64), unpack(r["own"], bool), True

    def sums(self, k: int, low_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Histories of order k, and by column their lower mass, n-grams seen, and those seen 1..TOP times; owned ones only."""
        level = self.level[k]
        start = runs_of(level.of)
        c = np.where(level.own, level.total, 0)
        seen = c > 0
        lower = self.level[1].total[self.level[1].at[level.first]] if k == 2 else np.rint(low_p[level.first] * UNIT).astype(np.uint64)
        columns = [np.where(seen, lower, 0), seen, *(c == r for r in range(1, TOP + 1))]
        return level.of[start], np.stack([np.add.reduceat(x.astype(np.uint64), start) for x in columns])

    def followed(self, k: int) -> np.ndarray:
        """How often each history of order k is followed by a token in training; as often as documents end after no word."""
        ends = self.level[1].total[self.level[1].at[self.starts[0] + self.sizes[0] - 1]]
        return np.append(self.level[k - 1].total, ends)

    def backed_off(self, k: int) -> np.ndarray:
        """Whether a token of the chunk backs off from each history of order k."""
        level = self.level[k]
        out = np.zeros(len(self.level[k - 1].keys) + 1, bool)
        out[level.of[level.total == 0]] = True
        return out

    def asked(self, k: int, of: np.ndarray) -> np.ndarray:
        """Which of some histories of order k other chunks have, too: places in `of`, by key."""
        low = self.level[k - 1]
        some = np.flatnonzero(np.append(low.shared, True)[of])
        return some[np.argsort(np.append(low.keys, BEGIN)[of[some]])]


def _sent(kind: int, chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int, stats: np.ndarray | None = None, wanted: np.ndarray | None = None) -> pa.RecordBatch:
    """A chunk's keys, which ascend, and what belongs to them (by column, if it has several) by bucket; statistics go in a row of their own."""
    cuts = bucket_cuts(keys, buckets)
    has = np.flatnonzero(np.diff(cuts)).tolist()
    rows = [{"bucket": i, "keys": keys[cuts[i] : cuts[i + 1]].tobytes(), "counts": pack(counts[..., cuts[i] : cuts[i + 1]].ravel()), "stats": None if wanted is None else pack(wanted[cuts[i] : cuts[i + 1]])} for i in has]
    if stats is not None:
        rows.append({"bucket": chunk % buckets, "keys": b"", "counts": pack(np.zeros(0, np.uint32)), "stats": stats.tobytes()})
    return pa.RecordBatch.from_pylist([{"kind": kind, "chunk": chunk} | r for r in rows], _arrow(SENT))


def _stats(whole: np.ndarray) -> np.ndarray:
    """Seen n-grams, their counts' sum, and how many are seen 1..TOP+1 times."""
    often = np.bincount(np.minimum(whole, TOP + 2).astype(np.int64), minlength=TOP + 3)[1 : TOP + 2]
    return np.array([(whole > 0).sum(), whole.sum(), *often], np.int64)


def _summed(kind: int, bucket: int, rows: pa.Table) -> pa.Table:
    """One bucket of the n-grams of an order: whole counts to the chunks that aren't alone, and the bucket's statistics."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("keys")]
    counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in rows.column("counts")]).astype(np.uint64)
    sizes, keys = np.array([len(k) for k in keys]), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    start = runs_of(keys[order])
    size = np.diff(np.append(start, len(keys)))
    whole = np.add.reduceat(counts[order], start) if len(keys) else counts
    total, own, told = np.empty(len(keys), np.uint64), np.zeros(len(keys), bool), np.empty(len(keys), bool)
    total[order], told[order] = np.repeat(whole, size), np.repeat(size > 1, size)
    own[order[start]] = True
    stats = _stats(whole) + sum(np.frombuffer(x, np.int64) for x in rows.column("stats").to_pylist() if x)
    out = [{"kind": kind, "stats": stats.tolist()}]
    begin = np.cumsum(sizes) - sizes
    for chunk, lo, n in zip(rows.column("chunk").to_pylist(), begin.tolist(), sizes.tolist()):
        here = lo + np.flatnonzero(told[lo : lo + n])
        if len(here):
            out.append({"kind": kind, "chunk": chunk, "bucket": bucket, "places": pack(np.diff(here - lo, prepend=0).astype(np.uint32)), "counts": pack(total[here]), "own": pack(own[here])})
    return pa.Table.from_pylist(out, _arrow(ANSWER))


def discounts(often: list[int]) -> np.ndarray:
    """Good-Turing discount of counts 1..TOP from the numbers of n-grams seen 1..TOP+1 times (Katz).

    Where the numbers can't give one strictly between 0 and 1, r / (r + 1/2).
    """
    d, n = np.ones(TOP + 1), [0, *often]
    for r in range(1, TOP + 1):
        d[r] = r / (r + 0.5)
        if n[1] and n[r] and n[r + 1]:
            cut = (TOP + 1) * n[TOP + 1] / n[1]
            if cut < 1:
                got = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                d[r] = got if 0 < got < 1 else d[r]
    return d


def weights(sums: np.ndarray, k: int, d: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """From whole sums of histories of order k: whether one count more is set aside, as nothing is discounted, and the mass
    that is left over, in counts, by what the lower order leaves."""
    lower, seen, low = sums[0].astype(float), sums[1].astype(float), sums[2:].astype(float)
    cut = (np.arange(1, TOP + 1) * (1 - d[1:])) @ low
    mass = (lower + DELTA * seen) / norm if k == 2 else lower / UNIT
    return (cut <= 0) & (seen > 0), np.where(cut > 0, cut, 1) / np.maximum(1 - mass, 1e-300)


def _weighted(kind: int, bucket: int, rows: pa.Table, d: np.ndarray, norm: float) -> pa.Table:
    """Weights of a bucket's histories to each chunk that has them, in the chunk's order; left mass only where it is wanted."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("keys")]
    sums = np.concatenate([unpack(x.as_py(), np.uint64).reshape(2 + TOP, -1) for x in rows.column("counts")], axis=1)
    at, keys = np.concatenate([[0], np.cumsum([len(k) for k in keys])]), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    start = runs_of(keys[order])
    more, left = weights(np.add.reduceat(sums[:, order], start, axis=1), -kind, d, norm)
    size, extra, over = np.diff(np.append(start, len(keys))), np.empty(len(keys), bool), np.empty(len(keys))
    extra[order], over[order] = np.repeat(more, size), np.repeat(left, size)
    told = []
    for chunk, wanted, a, b in zip(rows.column("chunk").to_pylist(), rows.column("stats").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
        told.append({"kind": kind, "chunk": chunk, "bucket": bucket, "own": pack(extra[a:b]), "alpha": pack(over[a:b][unpack(wanted, bool)])})
    return pa.Table.from_pylist(told, _arrow(ANSWER))


class Model:
    """What every task knows: the order, buckets by order, and, once counted, the discounts and the words' norm."""

    def __init__(self, order: int, buckets: dict[int, int]):
        self.order, self.buckets, self.norm, self.d = order, buckets, 1.0, {}

    def histories(self, k: int) -> int:
        return self.buckets[min(k - 1, 2)]

    def chances(self, t: Chunk, told: pa.Table, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count of each token's n-gram and the token's probability, by order, each from the one below."""
        for k in range(1, upto + 1):
            level = t.level[1] if k == 1 else t.grow(k)
            t.hear(k, told, self.buckets[min(k, 2)])
            c = level.total[level.at]
            if k == 1:
                p = (c + DELTA) / self.norm
            else:
                spare, alpha = self.backoff(t, told, k, p)
                own = self.d[k][np.minimum(c, TOP + 1).astype(np.int64) % (TOP + 1)] * c  # counts over TOP: d[0] = 1
                p = np.where(c > 0, own / np.maximum(spare[level.hist], 1), alpha[level.hist] * p)
            yield c, p

    def backoff(self, t: Chunk, told: pa.Table, k: int, low_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Denominators and weights by history: the chunk's own ones from its own sums, the others as answered."""
        of, sums = t.sums(k, low_p)
        more, left = np.zeros(len(t.level[k - 1].keys) + 1, bool), np.ones(len(t.level[k - 1].keys) + 1)
        more[of], left[of] = weights(sums, k, self.d[k], self.norm)
        parts = sorted((r["bucket"], r["own"], r["alpha"]) for r in told.filter(pc.equal(told.column("kind"), -k)).select(["bucket", "own", "alpha"]).to_pylist())
        mine = of[t.asked(k, of)]
        more[mine] = np.concatenate([unpack(x[1], bool) for x in parts] or [np.zeros(0, bool)])
        left[mine[t.backed_off(k)[mine]]] = np.concatenate([unpack(x[2], float) for x in parts] or [np.zeros(0)])
        count = t.followed(k).astype(float)
        spare = count + more
        return spare, np.where(count > 0, left / np.maximum(spare, 1), 1.0)

    def gram_rows(self, t: Chunk, number: int, k: int) -> pa.RecordBatch:
        """What is sent of the n-grams of order k, with the statistics of those that aren't."""
        level, mine = t.level[k], t.sent(k)
        left = level.count.copy()
        left[mine] = 0
        return _sent(k, number, level.keys[mine], level.count[mine], self.buckets[min(k, 2)], _stats(left) if k > 2 else None)


def scored(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from the documents that aren't held out (null: not) and scores all. A null text is
    empty: its end is its only token. Null and repeated doc_ids keep their rows. An empty
    table gives no rows; without training documents all tokens are unknown. The order is 2 or more.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table = bucketed(chunks(chosen), "chunk", partitions(spark))
    tokens = table.select(F.sum("n")).first()[0] or 0
    model = Model(order, {1: buckets_for(spark, tokens / 6), 2: buckets_for(spark, tokens)})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = Chunk(row)
                yield model.gram_rows(t, row["chunk"], 1)
                t.grow(2)
                yield model.gram_rows(t, row["chunk"], 2)

    def bucket(key, rows):
        kind, number = key[0].as_py(), key[1].as_py()
        return _summed(kind, number, rows) if kind > 0 else _weighted(kind, number, rows, model.d[-kind], model.norm)

    def next_pass(k: int):
        """Sums of the histories of order k, and the n-grams of the next order."""

        def work(key, rows, told):
            out = []
            for row in rows.to_pylist():
                t = Chunk(row)
                *_, (_, low_p) = model.chances(t, told, k - 1)
                t.grow(k)
                t.hear(k, told, model.buckets[min(k, 2)])
                of, sums = t.sums(k, low_p)
                mine = t.asked(k, of)
                wanted = t.backed_off(k)[of[mine]]
                out.append(_sent(-k, row["chunk"], np.append(t.level[k - 1].keys, BEGIN)[of[mine]], sums[:, mine], model.histories(k), wanted=wanted))
                if k < order:
                    t.grow(k + 1)
                    out.append(model.gram_rows(t, row["chunk"], k + 1))
            return pa.Table.from_batches(out, _arrow(SENT))

        return work

    answers = None
    for k in range(1, order + 1):
        asked = table.mapInArrow(first, SENT) if k == 1 else table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(next_pass(k), SENT)
        got = written(asked.groupBy("kind", "bucket").applyInArrow(bucket, ANSWER), "answers", by="kind")
        rows = got.where("chunk IS NULL").groupBy("kind").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(TOP + 3)]).collect()
        stats = {r["kind"]: list(r)[1:] for r in rows}
        if k == 1:
            total = stats[1][1] if 1 in stats else 0
            model.norm = total + DELTA * ((stats[1][0] if 1 in stats else 0) + 1)
        model.d[k + 1] = discounts(stats[k + 1][2:] if k + 1 in stats else [0] * (TOP + 1))
        told = got.where("chunk IS NOT NULL").select(*TOLD)
        answers = told if answers is None else answers.unionByName(told)

    def score(key, rows, told):
        out = []
        for row in rows.to_pylist():
            t = Chunk(row)
            by_order = list(model.chances(t, told, order))
            (c_uni, base), (_, whole) = by_order[0], by_order[-1]
            add = lambda x: np.add.reduceat(x, t.starts)  # noqa: E731, B023
            found = [pa.array(row["doc_ids"], pa.int64()), pa.array(t.held), pa.array(t.sizes), pa.array(add((c_uni > 0).astype(np.int64))), pa.array(np.full(len(t.sizes), total), pa.int64()), pa.array(add(np.log10(base))), pa.array(add(np.log10(whole)))]
            out.append(pa.RecordBatch.from_arrays(found, schema=_arrow(SCORE)))
        return pa.Table.from_batches(out, _arrow(SCORE))

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORE)


def perplexity(log10: float, tokens: int) -> float:
    return math.pow(10, -log10 / tokens)
