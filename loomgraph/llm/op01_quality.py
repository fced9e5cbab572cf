"""Quality classifier: a weak-label model, and a hashed linear scorer trained on its labels.

Heuristic labellers vote good, bad or nothing on each document. All documents' votes are
counted by pattern (at most 3^labellers rows, so their size is bounded), and expectation
maximisation on that table estimates how often each labeller votes which way on good and on
bad documents. The posterior of each pattern is a soft label. A linear scorer over hashed
word shapes learns these labels from a bounded sample of TRAIN_DOCS documents and then
scores every whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import free_name, held, only, texts, written

#: Bound of the training sample: about as many documents, those with the smallest hashes of text and id.
TRAIN_DOCS = 20_000
#: Longer words are hashed in consecutive pieces of so many bytes.
PIECE = 48
DIMENSIONS, EPOCHS, REJECT_BELOW = 1 << 16, 200, 0.5
GOOD, BAD, NONE = 2, 1, 0
#: Those that only ever say "bad" or nothing, then those that say either.
LABELLERS = ("symbols", "marked words", "capitals", "exclamations", "bars", "repeats", "variety", "sentences")
#: Prior means of P(says bad | bad) and P(says bad | good) of a labeller, worth PRIOR of a class's documents.
SAYS_BAD, PRIOR = (0.35, 0.01), 0.2

_PLAIN = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b" \t\n\r\x0b\x0c.,;:!?'\"()-"
_MARKS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


def votes(text: bytes, words: list[bytes], repeated: int) -> int:
    """The labellers' votes on one text, as digits to the base 3."""
    n, size = len(words), max(1, len(text))
    odd = len(text.translate(None, _PLAIN)) / size
    upper, lower = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _LOWER))
    letters, per = max(1, upper + lower), max(1, n)
    marked = sum(w[-1] in _MARKS for w in words) / per
    variety, ends = len(set(words)) / per, sum(w[-1] in b".!?" for w in words) / per
    said = (
        BAD if odd > 0.05 else NONE,
        BAD if n >= 5 and marked > 0.2 else NONE,
        BAD if letters >= 20 and upper / letters > 0.4 else NONE,
        BAD if n >= 5 and text.count(b"!") / per > 0.2 else NONE,
        BAD if n >= 5 and text.count(b"|") / per > 0.15 else NONE,
        BAD if n >= 5 and repeated / per > 0.2 else NONE,
        NONE if n < 20 or n > 3000 else BAD if variety < 0.2 else GOOD if variety > 0.4 else NONE,
        NONE if n < 30 else BAD if ends < 0.005 or ends > 0.6 else GOOD if ends < 0.35 else NONE,
    )
    code = 0
    for v in said:
        code = code * 3 + v
    return code


class Shapes(dict):
    """Hashed shape of a word: its kinds of characters, runs counted once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        kinds, shape = word.translate(_SHAPE), bytearray()
        for c in kinds:
            if not shape or shape[-1] != c:
                shape.append(c)
        got = self[word] = xxhash.xxh32_intdigest(bytes(shape), 1) % (DIMENSIONS - 2)
        return got


_shapes = held("op01", Shapes())


def features(text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Vote pattern; hashed features and their weights: shares of word shapes and of repeated words."""
    words = text.split()
    if not words:
        return votes(text, words, 0), np.array([DIMENSIONS - 1]), np.ones(1, np.float32)
    repeated = sum(map(bytes.__eq__, words[1:], words[:-1]))
    pieces = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)] if max(map(len, words)) > PIECE else words
    ids, counts = np.unique(np.fromiter(map(_shapes.__getitem__, pieces), np.int64, len(pieces)), return_counts=True)
    return votes(text, words, repeated), np.append(ids, DIMENSIONS - 2), np.append(np.sqrt(counts / len(pieces)), np.sqrt(repeated / len(words))).astype(np.float32)


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over the pattern table: posterior of good by pattern, P(vote | class), share of good.

    Starts from the labellers' polarity. Priors that grow with the class keep class 1 the good
    one. A labeller's silence counts where silence is all it says of good documents; for
    labellers that say either, it tells nothing.
    """
    k = len(LABELLERS)
    digits = np.stack([codes // 3 ** (k - 1 - i) % 3 for i in range(k)], axis=1)
    either = (digits == GOOD).any(0)
    heard = (digits != NONE) | ~either
    bad = digits == BAD
    post = 0.1 ** np.minimum(bad.sum(1), 6) * 0.95
    for _ in range(rounds):
        share = ((post * counts).sum() + 0.95) / (counts.sum() + 1)
        says = np.empty((2, k))
        for y, w in ((1, post * counts), (0, (1 - post) * counts)):
            prior, mass = SAYS_BAD[y], PRIOR * w.sum() + 1
            says[y] = ((w[:, None] * (bad & heard)).sum(0) + prior * mass) / ((w[:, None] * heard).sum(0) + mass)
        logs = [(np.where(bad, np.log(says[y]), np.log1p(-says[y])) * heard).sum(1) for y in (0, 1)]
        odds = np.log(share) - np.log1p(-share) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(codes.tolist(), post.tolist())), says, float(share)


def train(rows: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam steps."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return w, bias
    y = np.array([r[0] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at, x = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(float)
    used, at = np.unique(at, return_inverse=True)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    theta = np.zeros(len(used) + 1)
    for t in range(1, EPOCHS + 1):
        z = np.bincount(of, weights=theta[at] * x, minlength=len(rows)) + theta[-1]
        g = (1 / (1 + np.exp(-z)) - y) / len(y)
        grad = np.append(np.bincount(at, weights=g[of] * x, minlength=len(used)), g.sum()) + 1e-6 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[used] = theta[:-1]
    return w, float(theta[-1])


def fitted(docs: DataFrame, text: str = "text"):
    """Labels and trains: (posterior by pattern, P(vote | class), weights, bias)."""
    chosen = docs.select(F.col(text).alias("text"), F.xxhash64(text, *[c for c in ("doc_id",) if c in docs.columns]).alias("at"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op01")
        for b in batches:
            found = [features(t) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[2].tobytes() for f in found], pa.binary())],
                names=["at", "code", "ids", "shares"],
            )

    table = written(chosen.mapInArrow(work, "at bigint, code bigint, ids binary, shares binary"), "votes")
    patterns = table.groupBy("code").count().collect()  # at most 3^labellers rows
    if not patterns:
        return {}, None, np.zeros(DIMENSIONS), 0.0
    codes, counts = (np.array([r[i] for r in patterns], np.int64) for i in (0, 1))
    posterior, accuracies, _ = estimate(codes, counts)
    cut = -(1 << 63) + min((1 << 64) - 1, (TRAIN_DOCS << 64) // int(counts.sum()))
    # repeated rows share a hash and count once; about TRAIN_DOCS rows are left, the bound is never met
    sample = table.where(F.col("at") <= F.lit(cut)).distinct().orderBy("at", "ids").limit(2 * TRAIN_DOCS).select("code", "ids", "shares").collect()
    w, bias = train([(posterior[r[0]], np.frombuffer(r[1], "<i4").astype(np.int64), np.frombuffer(r[2], np.float32)) for r in sample])
    return posterior, accuracies, w, bias


def classified(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds weak_label (posterior of good from the votes), quality (the scorer's probability) and keep.

    A null or wordless text has its own feature; labellers abstain on what is too short to
    judge. All rows, repeats and columns stay; columns of these names are replaced. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    posterior, _, w, bias = fitted(docs, text)
    model = spark.sparkContext.broadcast((posterior, w, bias))
    kept = docs.drop("weak_label", "quality", "keep")
    at = kept.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("op01")
        posterior, w, bias = model.value
        for b in batches:
            label, score = [], []
            for t in texts(b.column(at)):
                code, ids, x = features(t)
                label.append(posterior.get(code, 0.5))
                score.append(1 / (1 + np.exp(-np.clip(float(w[ids] @ x) + bias, -50, 50))))
            score = np.round(np.array(score, float), 9)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.float64()), pa.array(score), pa.array(score >= REJECT_BELOW)], names=[*b.schema.names, "weak_label", "quality", "keep"])

    schema = T.StructType([*kept.schema.fields, T.StructField("weak_label", T.DoubleType()), T.StructField("quality", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return kept.mapInArrow(work, schema)


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    mark = {c: free_name(docs, f"_{c}") for c in ("weak_label", "quality", "keep") if c in docs.columns}
    scored = classified(docs.withColumnsRenamed(mark), text).where("keep").drop("weak_label", "quality", "keep")
    return scored.withColumnsRenamed({v: k for k, v in mark.items()})
