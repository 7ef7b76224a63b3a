"""Document fingerprints (operator 10): prefix polynomial hashes.

A text's code points give prefix sums of two polynomials modulo 2**31 - 1.
From these any span's hash takes one subtraction, so equality of any two spans
costs one step and the longest common extension of two places a binary search.

A fingerprint holds the length, the hash of the whole text, and one byte for
each of ``BINS`` bins: of the hashes of all ``SPAN``-character spans that fall
into a bin, the smallest one's. Likeness is the share of equal bins among
those that either text fills, corrected for chance: an estimate of the Jaccard
similarity of the span sets. Equal texts have equal fingerprints.

Each document is compared with the next one by id (the first after the last).
Documents are dealt into blocks of ascending ids and sorted within them; the
first document of each block also ends the block before.

Defined cases: a null text is an empty one; a text shorter than a span is one
span; two empty texts have likeness 1, an empty and a full one 0; null ids come
first; rows with one id follow one another by their text; a table of one row
is its own next. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, id_blocks, mix64, shuffle_partitions

SPAN = 16
BINS = 128
_P = np.uint64((1 << 31) - 1)
_BASES = (1_103_515_245, 1_664_525_019)
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**62."""
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.where(x >= _P, x - _P, x)


class _Tables:
    """Powers of the bases and of their inverses, grown on demand per worker."""

    def __init__(self) -> None:
        self.size, self.pairs = 0, []

    def get(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.size:
            self.size = 1 << max(12, (n - 1).bit_length())
            self.pairs = [(self._row(b), self._row(pow(b, -1, int(_P)))) for b in _BASES]
        return self.pairs

    def _row(self, base: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < self.size:
            out = np.concatenate([out, _mod(out * np.uint64(pow(base, len(out), int(_P))))])
        return out


_TABLES = _Tables()


class PrefixHashes:
    """Prefix hashes of a text's code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.tables = _TABLES.get(self.n + 1)
        self.sums = []
        for up, _ in self.tables:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            # each term is under 2**32, so no sum of fewer than 2**30 terms leaves the range of _mod
            np.cumsum(_mod(points * up[: self.n]), out=sums[1:])
            self.sums.append(_mod(sums))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        one, two = (
            _mod((sums[ends] + _P - sums[starts]) * down[starts])
            for sums, (_, down) in zip(self.sums, self.tables, strict=True)
        )
        return (one << np.uint64(31)) | two

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def edited(self, keep: int, other: PrefixHashes, take: int) -> PrefixHashes:
        """Of this text's first ``keep`` code points and the other's first ``take``, from both prefix arrays."""
        new = PrefixHashes("")
        new.n, new.sums = keep + take, []
        new.tables = _TABLES.get(new.n + 1)
        for own, others, (up, _) in zip(self.sums, other.sums, new.tables, strict=True):
            new.sums.append(np.concatenate([own[: keep + 1], _mod(own[keep] + others[1 : take + 1] * up[keep])]))
        return new

    def values(self) -> np.ndarray:
        """Mixed hashes of all ``SPAN``-character spans, by start; of the whole text if it is shorter."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        starts = np.arange(max(self.n - SPAN, 0) + 1)
        return mix64(self.spans(starts, np.minimum(starts + SPAN, self.n)))

    def common_extension(self, at: int, other: PrefixHashes, other_at: int) -> int:
        """Length of the longest equal spans that begin at the two places, by binary search."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(other_at, other_at + middle):
                low = middle
            else:
                high = middle - 1
        return low


def edited_values(hashes: PrefixHashes, keep: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``values`` of a text edited after ``keep``: ``one`` and ``two`` are those of the texts it is made of.

    A span's hash doesn't depend on its place, so only spans across the seam are new.
    """
    if hashes.n < SPAN:
        return hashes.values()
    seam = np.arange(max(keep - SPAN + 1, 0), min(keep, hashes.n - SPAN + 1))
    crossing = mix64(hashes.spans(seam, seam + SPAN))
    return np.concatenate([one[: max(keep - SPAN + 1, 0)], crossing, two[: max(hashes.n - keep - SPAN + 1, 0)]])


def fingerprint(hashes: PrefixHashes, values: np.ndarray | None = None) -> str:
    """length:hash:bins, in hexadecimal; a bin that no span falls into is 00."""
    n, bins = hashes.n, np.zeros(BINS, dtype=np.uint8)
    if n:
        found = np.sort(hashes.values() if values is None else values)
        edges = np.searchsorted(found, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
        full = np.flatnonzero(np.diff(edges, append=len(found)))
        bins[full] = 1 + (found[edges[full]] >> np.uint64(8)) % np.uint64(255)
    return f"{n:x}:{hashes.span(0, n):x}:{bins.tobytes().hex()}"


def likeness(one: str, two: str) -> float:
    """Estimated share of common spans, from two fingerprints."""
    if one == two:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x.rpartition(":")[2]), dtype=np.uint8) for x in (one, two))
    union = int(((a > 0) | (b > 0)).sum())
    if not union:
        return 0.0
    equal = int(((a == b) & (a > 0)).sum()) / union
    return max(0.0, (equal - 1 / 255) / (1 - 1 / 255))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block follow one another by id; each is compared with the row after it."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    before = None
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("block", "tail", "id", "text"))
        for block, tail, doc, text in zip(*columns, strict=True):
            text = text or ""
            hashes = PrefixHashes(text)
            values = hashes.values()
            own = fingerprint(hashes, values)
            if before and before[0] == block:
                _, last, last_text, last_hashes, last_values, last_print = before
                moved = len(last_text) // 4
                keep = len(last_text) - moved
                edited = last_text[:keep] + text[:moved]
                edited_hashes = last_hashes.edited(keep, hashes, len(edited) - keep)
                edited_print = fingerprint(edited_hashes, edited_values(edited_hashes, keep, last_values, values))
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                near = likeness(last_print, edited_print), likeness(last_print, own)
                common = last_hashes.common_extension(0, edited_hashes, 0)
                out.append((last, len(last_text), digest, last_print, edited_print, *near, common))
            before = None if tail else (block, doc, text, hashes, values, own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the next document's first.

    ``common_prefix`` is how many code points a text and its edited text share
    from the start. Other columns are as the module says.
    """
    spark = bound_batches(docs).sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(
        id_blocks(docs, f"`{id_col}`", parts).alias("block"),
        F.lit(False).alias("tail"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    # the first id of each block: at most one row a block, and there are no more blocks than partitions
    firsts = rows.groupBy("block").agg(F.min(F.struct("id")).alias("first")).collect()
    firsts = sorted((r["block"], r["first"]["id"]) for r in firsts)
    heads = [(b, i, firsts[k - 1][0]) for k, (b, i) in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "block int, id long, target int")
    tails = (
        rows.alias("r")
        .join(F.broadcast(heads.alias("h")), (F.col("r.block") == F.col("h.block")) & F.col("r.id").eqNullSafe(F.col("h.id")))
        .groupBy(F.col("target").alias("block"), F.lit(True).alias("tail"), F.col("r.id").alias("id"))
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    ordered = rows.union(tails).repartition(parts, "block").sortWithinPartitions("block", "tail", "id", "text")
    return ordered.mapInArrow(_compare, RESULT)


def op10_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of every document, its edited text and the next document."""
    return fingerprints(docs.select("doc_id", "text"))
