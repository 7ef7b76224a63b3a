"""Token counts (operator 7): offset-mapped attribution.

A document is encoded once as a whole, with each token's span of characters.
An interval join of these spans with the document's sections gives every token
to one section. A token across a boundary goes where ``rule`` says: "largest"
(the section with most of its characters, the first of equal ones), "first" or
"last" (the section of its first or last character). So the sections' counts
always add up to the document's.

Sections are the lines of a text, each with its line break, unless a function
is given that cuts a text otherwise; the fields of a record are counted by
joining them with their separators first and cutting there.

The vocabulary's rule splits texts before it merges, and never within a part
as cut here (one blank at most, then no white space; or a run of white space).
So distinct parts are encoded once, and looked up afterwards.

Defined cases: a null or empty text has one section without tokens; a token
without characters goes where it begins; equal rows are counted one by one.
Only the id and text columns are read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches
from glmframe.llm.merges import BYTE_LEVEL, CACHE_PIECES, Merges, check_rules

#: Unicode white space, as the vocabulary's pattern has it (fixed value).
_SPACE = "\t-\r \x85\xa0  -     　"
_PART = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Distinct parts a worker remembers at most; beyond it starts anew.
CACHE_PARTS = 150_000
RESULT = "doc_id long, section long, start long, length long, n_tokens long, n_crossing long"


#: How the vocabulary splits Latin text.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\w\s])+|\s+(?!\S)|\s+")


class SpanEncoder:
    """Spans (start, end) of a text's tokens, in characters, through bounded caches of parts and of pieces."""

    def __init__(self, path: str):
        from tokenizers import processors

        self.merges = Merges(path)
        self.merges.whole.encode_special_tokens = True
        self.merges.whole.post_processor = processors.ByteLevel(trim_offsets=False)
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        """start, end, start, end ... of a piece's tokens."""
        found = self.pieces.get(piece)
        if found is None:
            ends = list(accumulate(len(t.value) for t in self.merges.tokens(piece)))
            found = [x for both in zip([0, *ends], ends, strict=False) for x in both]
            if not piece.isascii():  # bytes to the characters they belong to
                of = [k for k, c in enumerate(piece) for _ in c.encode()]
                found = [of[x - 1] + 1 if k % 2 else of[x] for k, x in enumerate(found)]
            self.pieces[piece] = found
        return found

    def spans(self, texts: list[str]) -> Iterator[np.ndarray]:
        found = [_PART.findall(t) for t in texts]
        if len(self.parts) > CACHE_PARTS:
            self.parts = {}
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        known, odd = self.parts, []
        for part in {p for own in found for p in own}.difference(known):
            if self.merges.plain(part):
                at, own = 0, []
                for piece in _PIECE.findall(part):
                    own += [at + x for x in self._piece(piece)] if at else self._piece(piece)
                    at += len(piece)
                known[part] = array("i", own).tobytes()
            else:
                odd.append(part)
        for part, coded in zip(odd, self.merges.whole.encode_batch(odd, add_special_tokens=False), strict=True):
            known[part] = np.array(coded.offsets, dtype="<i4").tobytes()
        for own in found:
            values = [known[p] for p in own]
            counts = np.fromiter(map(len, values), dtype=np.int64, count=len(own)) // 8
            ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
            begin = np.concatenate([[0], ends[:-1]]) if len(own) else ends
            yield np.frombuffer(b"".join(values), dtype="<i4").reshape(-1, 2) + np.repeat(begin, counts)[:, None]


@lru_cache(maxsize=1)
def _encoder(path: str) -> SpanEncoder:
    """One a worker: what it remembers serves its next tasks."""
    return SpanEncoder(path)


def line_starts(text: str) -> np.ndarray:
    """Where each line begins."""
    breaks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 0x0A
    return np.concatenate([[0], np.flatnonzero(breaks) + 1])


def attribute(spans: np.ndarray, starts: np.ndarray, length: int, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a boundary; sections [start, next start) cover the text."""
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    last = np.maximum(first, np.searchsorted(starts, spans[:, 1] - 1, side="right") - 1)
    crossing = first < last
    if rule == "last":
        return last, crossing
    out = first.copy()
    if rule == "largest":
        ends = np.append(starts[1:], length)
        for k in np.flatnonzero(crossing).tolist():
            a, b = spans[k]
            among = np.arange(first[k], last[k] + 1)
            out[k] = among[np.argmax(np.minimum(ends[among], b) - np.maximum(starts[among], a))]
    elif rule != "first":
        raise ValueError(f"unknown rule {rule!r}: largest, first or last")
    return out, crossing


def section_token_counts(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    rule: str = "largest",
    sections: Callable[[str], np.ndarray] = line_starts,
) -> DataFrame:
    """One row per section: doc_id, section (from 0), start, length, n_tokens, n_crossing (of these, across a boundary).

    ``vocabulary`` is a byte-level tokenizers file without a normalizer; any other raises.
    """
    if rule not in ("largest", "first", "last"):
        raise ValueError(f"unknown rule {rule!r}: largest, first or last")
    check_rules(vocabulary, None, BYTE_LEVEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 512):
                some, columns, owners = texts[at : at + 512], [], []
                for doc, text, spans in zip(ids[at : at + 512], some, encoder.spans(some), strict=True):
                    starts = sections(text)
                    n = len(starts)
                    where, crossing = attribute(spans, starts, len(text), rule)
                    counted = np.bincount(where, minlength=n), np.bincount(where[crossing], minlength=n)
                    columns.append((np.arange(n), starts, np.diff(starts, append=len(text)), *counted))
                    owners += [doc] * n
                joined = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), *joined], names=names)

    rows = bound_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, RESULT)


def op7_token_counts(docs: DataFrame) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    return section_token_counts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
