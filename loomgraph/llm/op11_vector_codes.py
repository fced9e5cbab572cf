"""Vector codes by parts: each part of a vector becomes the index of its nearest codebook entry.

Vectors are integers, floor(1024 x), cut into equal consecutive parts. Every part position
has a vantage-point tree over its codebook's entries: a node holds a vantage entry and two
halves of the others, by distance from it, and of each half the nearest and the farthest
distance. A search first runs down to the nearer half, then visits every half whose lower
bound, by the triangle inequality, is not above the best distance so far: radii are
rounded outwards and the test isn't strict, so that no entry as near as the best, of lower
index, is missed. Distances are integers; ties go to the lower index.

Spark reads the vectors once a round; a task sends sums and counts of its parts by entry,
so that what travels is bounded by the codebook, and the driver holds the codebook alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a tree's leaf.
LEAF = 16
#: Components up to which distances and sums of a batch are exact in 64-bit floats; beyond, Python's integers.
EXACT = 1 << 20
#: Components of 2^90 or more count as non-finite: sums of them would not fit 38 digits.
LARGEST = 2.0**90
MOST_LONG = (1 << 63) - 1
OUT, IN = 1 + 1e-9, 1 - 1e-9


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x), in floats where all are small (they are exact), else as Python's integers."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() > EXACT:
        return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)
    return scaled


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of every row of a from every row of b."""
    if a.dtype == object or b.dtype == object:
        d = a.astype(object)[:, None, :] - b.astype(object)[None, :, :]
        return (d * d).sum(axis=2)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)


class Node:
    """A leaf's entries, or a vantage entry with two halves and their distances from it."""

    def __init__(self, points: np.ndarray, entries: np.ndarray):
        self.entries, self.halves = entries, []
        self.points = points[entries]
        if len(entries) <= LEAF:
            return
        far = np.sqrt(squared(self.points[:1], self.points)[0].astype(np.float64))
        order = np.argsort(far[1:], kind="stable") + 1
        self.vantage, self.entries, self.points = entries[0], entries[:1], self.points[:1]
        for half in np.array_split(order, 2):
            self.halves.append((far[half].min() * IN, far[half].max() * OUT, Node(points, np.sort(entries[half]))))


class Search:
    """Nearest entries of many parts at once."""

    def __init__(self, points: np.ndarray):
        self.root = Node(points, np.arange(len(points)))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance from the nearest entry of each part."""
        self.parts = parts
        self.best = np.full(len(parts), np.inf, object if parts.dtype == object else np.float64)
        self.index = np.full(len(parts), -1)
        rows = np.arange(len(parts))
        if len(rows):
            self._down(self.root, rows)
            self._visit(self.root, rows)
        return self.index, self.best

    def _seen(self, node: Node, rows: np.ndarray) -> np.ndarray:
        """Takes a node's own entries into account; the distances from its first."""
        far = squared(self.parts[rows], node.points)
        at = far.argmin(axis=1)  # the first of equal ones: entries ascend
        least, index = far[np.arange(len(rows)), at], node.entries[at]
        better = (least < self.best[rows]) | ((least == self.best[rows]) & (index < self.index[rows]))
        self.best[rows[better]], self.index[rows[better]] = least[better], index[better]
        return np.sqrt(far[:, 0].astype(np.float64))

    def _down(self, node: Node, rows: np.ndarray) -> None:
        far = self._seen(node, rows)
        if node.halves:
            (_, edge, near), (_, _, other) = node.halves
            for half, inside in ((near, far <= edge), (other, far > edge)):
                if inside.any():
                    self._down(half, rows[inside])

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        far = self._seen(node, rows)
        for low, high, half in node.halves:
            bound = np.maximum(low - far * OUT, far * IN - high) * IN
            going = bound <= np.sqrt(self.best[rows].astype(np.float64)) * OUT
            if going.any():
                self._visit(half, rows[going])


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, not empty, and has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    return vectors.where(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return integers(np.asarray(column.flatten()).reshape(-1, width))


def _edges(width: int) -> list[int]:
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(width), PARTS)]).tolist()]


def _summed(kept: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts are nearest to it, and their sums; one round over all vectors."""
    edges = _edges(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(book) for book in books]
        n = [np.zeros(len(book), np.int64) for book in books]
        sums = [np.zeros(book.shape, object) for book in books]
        for b in batches:
            whole = _matrix(b.column(0), width)
            for p, search in enumerate(searches):
                own = whole[:, edges[p] : edges[p + 1]]
                index, _ = search.nearest(own)
                n[p] += np.bincount(index, minlength=len(n[p]))
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                sums[p][used] += _whole(np.add.reduceat(own[order], first, axis=0)) if len(used) else 0
        for p, counts in enumerate(n):
            used = np.flatnonzero(counts)
            rows = [[Decimal(int(x)) for x in sums[p][e]] for e in used]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(rows, pa.list_(pa.decimal128(38, 0)))],
                names=["part", "entry", "n", "sums"],
            )

    got = kept.mapInArrow(work, "part int, entry int, n bigint, sums array<decimal(38,0)>")
    longest = max(book.shape[1] for book in books)
    total = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(longest)]
    rows = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # at most PARTS * ENTRIES
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{j}"]) for j in range(books[r["part"]].shape[1])]) for r in rows}


def _whole(sums: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in sums], object).reshape(sums.shape)


def codebooks(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> tuple[list[np.ndarray], int]:
    """Codebooks of the part positions and the vectors' length; none of an empty table.

    They start as the parts of the ENTRIES smallest vec_ids (a null vec_id is the largest,
    equal ones go by their vectors) and are moved ROUNDS times. Vectors of another length
    than the first one's are left out.
    """
    kept = usable(vectors, vector)
    order = [F.col(vec_id).asc_nulls_last(), F.col(vector)]
    first = kept.orderBy(*order).select(F.size(vector)).limit(1).collect()
    if not first:
        return [], 0
    width = first[0][0]
    kept = kept.where(F.size(vector) == width).select(vec_id, vector)
    start = integers(np.array([r[1] for r in kept.orderBy(*order).limit(ENTRIES).collect()], np.float64))
    edges = _edges(width)
    books = [start[:, x:y] for x, y in zip(edges[:-1], edges[1:])]
    for _ in range(ROUNDS):
        books = [book.copy() for book in books]
        for (p, e), (n, sums) in _summed(kept.select(vector), books, width).items():
            books[p][e] = [s // n for s in sums]
    return books, width


def encoded(vectors: DataFrame, books: list[np.ndarray], width: int, vector: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """Adds each vector's code, two hex digits a part, and its error; rows without a usable vector go.

    An error beyond 64 bits is the largest 64-bit integer. Columns named as the new ones are replaced.
    """
    kept = usable(vectors.drop(code, error), vector).where(F.size(vector) == width)
    at, edges = kept.columns.index(vector), _edges(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(book) for book in books]
        for b in batches:
            whole = _matrix(b.column(at), width)
            found = [s.nearest(whole[:, x:y]) for s, x, y in zip(searches, edges[:-1], edges[1:])]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(i.tolist() for i, _ in found))]
            errors = [min(int(sum(map(int, row))), MOST_LONG) for row in zip(*(d.tolist() for _, d in found))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*b.schema.names, code, error])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())]))


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def label_errors(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Adds label_error, the error summed over equal labels, nulls together (at most the largest 64-bit integer).

    A label with a thousandth of the rows or more is looked up in a broadcast table, which
    thus has at most a thousand rows; the others are joined.
    """
    totals = coded.groupBy(label).agg(F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(MOST_LONG)).cast("bigint").alias("label_error"), F.count("*").alias("_n"))
    totals = written(totals, "labels")
    rows = totals.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    named = lambda t: t.select(F.col(label).alias("_label"), "label_error")
    often = F.broadcast(named(totals.where(F.col("_n") * 1000 >= rows)).withColumn("_often", F.lit(True)))
    same = F.col(label).eqNullSafe(F.col("_label"))
    first = coded.join(often, same, "left").drop("_label")
    rest = first.where(F.col("_often").isNull()).drop("label_error", "_often").join(named(totals.where(F.col("_n") * 1000 < rows)), same).drop("_label")
    return first.where("_often").drop("_often").unionByName(rest)


def digest(vectors: DataFrame) -> DataFrame:
    """Per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, empty, or hold a null or non-finite component go; so do those of
    another length than that of the smallest vec_id. Repeated rows are kept, null vec_ids
    and labels too. No usable vector gives no rows.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    books, width = codebooks(vectors)
    if not books:
        return vectors.limit(0).selectExpr("vec_id", "'' code", "0L error", "0L label_error", "'' codebooks_sha256")
    coded = written(encoded(vectors, books, width).drop("embedding"), "codes")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _round(r: int) -> str:
    return f"""
 near{r} AS MATERIALIZED (
  SELECT id, p, min(struct_pack(d := list_dot_product(q, q) - 2 * list_dot_product(q, e) + list_dot_product(e, e), i := entry)) m
  FROM parts JOIN book{r} USING (p) GROUP BY id, p)"""


def _moved(r: int) -> str:
    return f"""
 moved{r} AS (SELECT p, entry, list(s ORDER BY j) e FROM (
   SELECT parts.p, near{r}.m.i entry, j, floor(sum(q[j]) / count(*)) s FROM parts JOIN near{r} USING (id, p), range(1, 17) t(j) GROUP BY ALL) GROUP BY ALL),
 book{r + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m.e, b.e) e FROM book{r} b LEFT JOIN moved{r} m USING (p, entry))"""


#: For vectors of 64 components and unique vec_ids; sums and products are exact in doubles.
ORACLE_SQL = (
    """WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 id, vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 parts AS MATERIALIZED (SELECT id, p, v[p * 16 + 1 : p * 16 + 16] q FROM kept, range(4) t(p)),
 book0 AS (SELECT p, id entry, q e FROM parts WHERE id < 256),"""
    + ",".join(_round(r) + "," + _moved(r) for r in range(ROUNDS))
    + ","
    + _round(ROUNDS)
    + f"""
, coded AS (
  SELECT id, string_agg(printf('%02x', m.i), '' ORDER BY p) code, sum(m.d)::BIGINT error FROM near{ROUNDS} GROUP BY id),
 sha AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY p, entry, j)) h FROM (SELECT p, entry, j, e[j] x FROM book{ROUNDS}, range(1, 17) t(j)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error, h codebooks_sha256 FROM coded JOIN kept USING (id), sha"""
)
