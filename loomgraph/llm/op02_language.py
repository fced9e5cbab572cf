"""Language ID: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest ridge.

A text is the set of its byte n-grams, n = 1 to SPECTRUM, hashed to COLUMNS bins; letters'
case and other ASCII characters are folded. The kernel of two texts is the size of the
common set over the geometric mean of the sizes. LANDMARKS training texts give Nystroem
features, on which one ridge regression a language is solved. Texts are scored in batches:
presence matrix times landmark matrix, then times the coefficients.

Fitting takes a sample of about TRAIN_DOCS labelled texts, equally many a language, those
with the smallest hashes; everything else runs over all texts, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import texts

SPECTRUM, COLUMNS_BITS = 4, 13
COLUMNS = 1 << COLUMNS_BITS
#: Bounds of the sample: labelled texts, and landmarks among them.
TRAIN_DOCS, LANDMARKS, RIDGE = 2_000, 192, 1e-2
UNKNOWN = "und"
_FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256)).lower()
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    return len(text.translate(None, _ASCII_LETTERS)) < len(text) or bool(_LETTER.search(text.decode("utf-8", "replace")))


def bins(text: bytes) -> np.ndarray:
    """Presence of each bin of n-grams in a whole text."""
    seen = np.zeros(COLUMNS, bool)
    for at in range(0, max(1, len(text)), 1 << 20):  # long texts in overlapping pieces
        b = np.frombuffer((b" " * (at == 0)) + text[at : at + (1 << 20) + SPECTRUM - 1].translate(_FOLD), np.uint8).astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(SPECTRUM):
            if len(b) <= n:
                break
            code = (code[: len(b) - n] << np.uint32(8)) | b[n:]
            seen[((code + np.uint32(n)) * _ODD[n] >> np.uint32(32 - COLUMNS_BITS)).astype(np.int64)] = True
    return seen


class Model:
    """Landmarks and coefficients."""

    def __init__(self, presence: np.ndarray, langs: list[str]):
        """presence: one row of bins a training text."""
        self.langs = sorted(set(langs))
        pick = self._spread(langs, min(LANDMARKS, len(langs)))
        self.marks = self._scaled(presence[pick]).T.copy()
        kmm = self._scaled(presence[pick]) @ self.marks
        value, vector = np.linalg.eigh(kmm.astype(float))
        keep = value > 1e-6 * value[-1]
        self.root = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
        phi = np.vstack([self.features(presence[i : i + 500]) for i in range(0, len(presence), 500)]).astype(float)
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        gram = phi1.T @ phi1 + RIDGE * np.eye(phi1.shape[1])
        self.weights = np.linalg.solve(gram, phi1.T @ y).astype(np.float32)

    @staticmethod
    def _spread(langs: list[str], n: int) -> list[int]:
        """n rows, the languages in turn."""
        seen: dict[str, int] = {}
        turn = []
        for i, lang in enumerate(langs):
            turn.append((seen.setdefault(lang, 0), lang, i))
            seen[lang] += 1
        return [i for _, _, i in sorted(turn)[:n]]

    @staticmethod
    def _scaled(presence: np.ndarray) -> np.ndarray:
        size = np.maximum(presence.sum(1, keepdims=True), 1)
        return presence.astype(np.float32) / np.sqrt(size, dtype=np.float32)

    def features(self, presence: np.ndarray) -> np.ndarray:
        return (self._scaled(presence) @ self.marks) @ self.root

    def predict(self, presence: np.ndarray) -> tuple[list[str], np.ndarray]:
        out = self.features(presence) @ self.weights[:-1] + self.weights[-1]
        best = out.argmax(1)
        return [self.langs[i] for i in best], np.clip((out[np.arange(len(out)), best].astype(float) + 1) / 2, 0, 1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from rows with text and lang; None where there are none."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(*[c for c in ("doc_id",) if c in docs.columns], text).alias("at")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    share = TRAIN_DOCS / len(sizes)
    cut = {k: -(1 << 63) + min((1 << 64) - 1, int(share * 2**64) // n) for k, n in sizes.items()}
    bound = F.create_map(*[F.lit(x) for k, v in cut.items() for x in (k, v)])
    sample = known.where(F.col("at") <= bound[F.col("lang")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [np.packbits(bins(t)).tobytes() for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(seen, pa.binary())], names=["lang", "at", "bins"])

    # repeated rows share a hash and count once; about TRAIN_DOCS rows are left, the bound is never met
    rows = sample.mapInArrow(work, "lang string, at bigint, bins binary").distinct().orderBy("at", "lang", "bins").limit(2 * TRAIN_DOCS).collect()
    presence = np.unpackbits(np.stack([np.frombuffer(r[2], np.uint8) for r in rows]), axis=1).astype(bool)
    return Model(presence, [r[0] for r in rows])


def identified(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    Learns only from text and lang of rows not held out. A null text, one without a letter,
    and any text where nothing could be learned is `und` with score 0. Null and repeated
    doc_ids keep their rows; a null held_out counts as held out; an empty table gives no rows.
    """
    held = F.coalesce(held_out, F.lit(True))
    model = fit(docs.where(~held), text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                own = texts(part.column(2))
                known = np.array([has_letter(t) for t in own], bool) & (model is not None)
                pred, score = np.full(len(own), UNKNOWN, object), np.zeros(len(own))
                if known.any():
                    pred[known], score[known] = model.predict(np.stack([bins(t) for t, k in zip(own, known) if k]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(np.round(score, 6))], names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return chosen.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")
