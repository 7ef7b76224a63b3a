"""Quality classifier (operator 1): nearest-neighbour voting on latent-semantic vectors.

A document's terms are its hashed words, the pairs of character classes that
follow one another in it, and how often it repeats words. Square roots of term
shares, weighted by inverse document frequency, are projected by a truncated
SVD fitted on the labelled sample. Every document is compared with all
labelled vectors in blocks (exact cosines); its ``NEIGHBOURS`` nearest vote,
each with its cosine to the power ``SHARPNESS``.

The fit uses at most ``SAMPLE`` labelled documents (a documented bound: the
smallest hashes of the ids), so vectors and projection, about 2 MB, can be
broadcast whatever the input's size. Labels are never inputs of a score.

Defined cases: null, empty and white-space texts have no terms and get the
mean label of the sample; without any labelled row every score is 0.5.
Repeated rows are scored alike; of several labels of one document the largest
counts, null labels don't; of labelled rows that repeat an id with other texts
one teaches, that with the least term numbers. Other columns, whatever their names, pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, slices, utf8, with_row, words_of

SAMPLE = 4096
WORD_TERMS = 1024
DIMENSIONS = 48
NEIGHBOURS = 31
SHARPNESS = 8
ACCEPT = 0.3
BLOCK = 1024


def _classes() -> np.ndarray:
    """Class of each byte: blank, break, lower, upper, digit, inner and first bytes beyond ASCII, each sign its own."""
    out = np.full(256, 1)
    out[0x20], out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x80:0xC0], out[0xC0:] = 0, 2, 3, 4, 5, 6
    signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    out[signs] = 7 + np.arange(len(signs))
    return out


_CLASS = _classes()
_N_CLASS = int(_CLASS.max()) + 1
_PAIRS = _N_CLASS * _N_CLASS
#: class pairs, words, words repeated at once, repeated words, repeated word triples
TERMS = _PAIRS + WORD_TERMS + 3


def term_counts(texts: list[bytes]) -> np.ndarray:
    """One row of term counts per text."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for a, b in slices(texts):
        _, _, hashes, first = words_of(texts[a:b])
        for i in range(a, b):
            own = hashes[first[i - a] : first[i - a + 1]]
            if not len(own):
                continue
            kinds = _CLASS[np.frombuffer(texts[i], dtype=np.uint8)]
            out[i, :_PAIRS] = np.bincount(kinds[:-1] * _N_CLASS + kinds[1:], minlength=_PAIRS)
            out[i, _PAIRS:-3] = np.bincount((own % np.uint64(WORD_TERMS)).astype(np.int64), minlength=WORD_TERMS)
            threes = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] if len(own) > 2 else own[:0]
            out[i, -3:] = (own[1:] == own[:-1]).sum(), len(own) - len(np.unique(own)), len(threes) - len(np.unique(threes))
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class NeighbourModel:
    """Inverse document frequencies, projection, labelled unit vectors and their labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> NeighbourModel:
        """Truncated SVD of the weighted terms by subspace iteration (fixed seed)."""
        idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.3)
        model = cls(idf, np.zeros((counts.shape[1], 0), np.float32), np.zeros((0, 0), np.float32), labels.astype(np.float32))
        if not len(counts):
            return model
        terms = model._weighted(counts)
        width = min(dimensions + 16, *terms.shape)
        basis = np.random.default_rng(7).standard_normal((terms.shape[1], width)).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(terms.T @ (terms @ basis))
        _, _, right = np.linalg.svd(terms @ basis, full_matrices=False)
        model.projection = (basis @ right.T)[:, :dimensions].astype(np.float32)
        model.vectors = _unit(terms @ model.projection)
        return model

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        share = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        return _unit(share * self.idf)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Similarity-weighted mean label of each text's nearest labelled vectors."""
        out = np.full(len(texts), float(self.labels.mean()) if len(self.labels) else 0.5)
        for a in range(0, len(texts) if len(self.labels) else 0, BLOCK):
            own = _unit(self._weighted(term_counts(texts[a : a + BLOCK])) @ self.projection)
            cosines = own @ self.vectors.T
            k = min(NEIGHBOURS, len(self.labels))
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            total = weights.sum(axis=1)
            some = total > 0
            out[a : a + BLOCK][some] = (weights * self.labels[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def held_out(id_col: str) -> Column:
    """Rows that never teach: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of a few documents, without their zeros."""
    for batch in batches:
        texts = utf8(batch.column("text"))
        at, counts = [], []
        for a in range(0, len(texts), BLOCK):
            for row in term_counts(texts[a : a + BLOCK]):
                full = np.flatnonzero(row)
                at.append(full.astype("<u2").tobytes())
                counts.append(row[full].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(at, pa.binary()), pa.array(counts, pa.binary())],
            names=["id", "label", "at", "counts"],
        )


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> NeighbourModel:
    """Fit on at most ``sample`` labelled documents that aren't held out."""
    label = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = (
        label.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = bound_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # at most ``sample`` ids: a broadcast of bounded size
    rows = (
        texts.join(F.broadcast(chosen), "id")
        .mapInArrow(_sample_terms, "id long, label int, at binary, counts binary")
        .groupBy("id", "label")
        .agg(F.min(F.struct("at", "counts")).alias("terms"))
        .select("id", "label", "terms.*")
        .collect()
    )
    rows.sort(key=lambda r: r["id"])
    counts = np.zeros((len(rows), TERMS), dtype=np.float32)
    for i, row in enumerate(rows):
        counts[i, np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["counts"], "<f4")
    return NeighbourModel.fit(counts, np.array([r["label"] for r in rows], dtype=np.float32))


def score_quality(docs: DataFrame, model: NeighbourModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all unless given), ``score`` and ``predicted`` (1: accepted)."""
    shared = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])

    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    found = rows.mapInArrow(run, with_row(rows, "score double"))
    return found.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op1_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score_quality(docs, fit_quality(docs, labels), keep=["doc_id"])
    return found.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")
