"""Substring dedup (operator 4): Rabin-Karp hashes of every word window, counted in Spark.

A word is covered, and removed, if some window of ``window`` consecutive words
around it also starts earlier: in a document with a smaller id, or earlier in
the same document. Windows are judged on the input.

Documents are dealt into blocks of ascending ids. Each block hashes all its
windows and sends the distinct ones, sorted, to hash buckets; so a passage
that a third of all documents share reaches a bucket once per block. A bucket
answers each block with one bit per hash: does an earlier block hold it? With
these bits a block, which sees its own documents in order, knows every window
that starts earlier, and merges repeated windows into maximal intervals.

Equality of windows is equality of 64-bit hashes.

Defined cases: a null or empty text has no words and stays as it is; a
document shorter than a window loses nothing; rows with one id are one place
ordered by their text, and of equal rows the first that the block lists stays
whole; null ids come first, dealt to blocks of their own by a hash of the text
and in the order of these blocks. Other columns, whatever their names, are passed
through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, id_blocks, shuffle_partitions, slices, span_hashes, utf8, with_row, words_of

WINDOW_WORDS = 20
#: Several blocks a partition even out what hashing deals to each.
BLOCKS_PER_PARTITION = 3
RESULT = "text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>"


def window_hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Hashes of all windows of all texts, the word each starts at, and per text its words' starts and ends.

    Words are numbered through all texts; a text's byte offsets are its own.
    """
    hashes, at, starts, ends, base = [], [], [], [], 0
    for a, b in slices(texts):
        s, e, h, first = words_of(texts[a:b])
        offset = np.cumsum([0, *(len(t) + 1 for t in texts[a:b])])
        for i in range(b - a):
            starts.append(s[first[i] : first[i + 1]] - offset[i])
            ends.append(e[first[i] : first[i + 1]] - offset[i])
        counts = np.maximum(np.diff(first) - window + 1, 0)
        begin = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        hashes.append(span_hashes(h, begin, begin + window))
        at.append(begin + base)
        base += len(s)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), starts, ends
    return np.concatenate(hashes), np.concatenate(at), starts, ends


def _packed(values: np.ndarray) -> bytes:
    """Sorted hashes as differences, of as many bytes as the largest needs (first byte: the width)."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max(initial=0)).bit_length() // 8))
    head = steps[:1].astype("<u8").tobytes()
    return bytes([width]) + head + steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    width, raw = blob[0], np.frombuffer(blob, dtype=np.uint8)
    rest = raw[9:].reshape(-1, width)
    steps = np.zeros((len(rest) + 1, 8), dtype=np.uint8)
    steps[0], steps[1:, :width] = raw[1:9], rest
    return np.cumsum(steps.view("<u8").ravel())


def _bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins: buckets are equal ranges of the hash values."""
    return np.searchsorted(((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def _block_hashes(window: int, buckets: int):
    """Per block: its distinct window hashes, one sorted blob per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            texts = utf8(batch.column("text"))
            for b in np.unique(block):
                own = [texts[i] for i in np.flatnonzero(block == b)]
                parts = held.setdefault(int(b), [])
                # slice by slice: words and offsets of a whole batch are never held at once
                parts.extend(np.unique(window_hashes(own[i:j], window)[0]) for i, j in slices(own))
        for b, parts in held.items():
            found = np.unique(np.concatenate(parts))
            edges = _bucket_edges(found, buckets)
            full = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array(np.full(len(full), b), pa.int32()),
                    pa.array([_packed(found[edges[k] : edges[k + 1]]) for k in full], pa.binary()),
                ],
                names=["bucket", "block", "hashes"],
            )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Per bucket: for each block, one bit per hash it sent, set where an earlier block sent it too."""
    table = table.sort_by("block")
    parts = [_unpacked(x) for x in table.column("hashes").to_pylist()]
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    seen = np.zeros(len(values), dtype=bool)
    seen[order[1:]] = ranked[1:] == ranked[:-1]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "bits": pa.array([np.packbits(x).tobytes() for x in np.split(seen, cuts)], pa.binary()),
            "n": pa.array([len(p) for p in parts], pa.int32()),
        }
    )


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple[bytes, list[dict]]:
    """The text without the words marked, the white space before each cut kept; and the intervals of words cut."""
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    spans, out, at = [], [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
        spans.append({"start": a, "end": b})
    tail = b"".join([*out, text[at:]])
    return (tail.rstrip(b" \t\n\x0b\x0c\r") if len(gone) and gone[-1] else tail), spans


def _apply(window: int):
    """Per block: which windows start earlier, and the documents without the words these cover."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        # ascending ids, null first; rows of one id by their text
        docs = docs.combine_chunks()
        ids, raw = docs.column("id").to_pylist(), docs.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, raw[i] is not None, raw[i] or ""))
        texts = [b"" if raw[i] is None else raw[i].encode() for i in order]
        hashes, at, starts, ends = window_hashes(texts, window)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.zeros(len(distinct), dtype=bool)
        if len(distinct):
            answers = answers.sort_by("bucket")
            bits = zip(answers.column("bits").to_pylist(), answers.column("n").to_pylist(), strict=True)
            known = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in bits]).astype(bool)
        later = known[which] | (first[which] != np.arange(len(hashes)))
        counts = np.array([len(s) for s in starts], dtype=np.int64)
        size = int(counts.sum()) + 1
        opened, closed = (np.bincount(at[later] + k, minlength=size) for k in (0, window))
        gone = np.cumsum(opened - closed)[:-1] > 0
        begin = np.concatenate([[0], np.cumsum(counts)])
        new: list = [None] * len(order)
        for k, i in enumerate(order):
            own = gone[begin[k] : begin[k + 1]]
            if own.any():
                text, spans = _cut(texts[k], starts[k], ends[k], own)
                new[i] = (text.decode(), len(own), int(own.sum()), spans)
            else:
                new[i] = (raw[i], len(own), 0, [])
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        columns = [pa.array([x[j] for x in new], kind) for j, kind in enumerate(kinds)]
        return pa.table([docs.column("row"), *columns], names=["row", "text", "n_words", "n_removed", "spans"])

    return run


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
    blocks: int | None = None,
) -> DataFrame:
    """Remove every word that a window seen earlier covers.

    Returns ``row`` (a struct of all columns of ``docs`` but the text), ``text``
    (without the removed words; null stays null), ``n_words``, ``n_removed``
    and ``spans`` (the removed intervals of word numbers, end exclusive).
    ``blocks`` is how many parts of the corpus are processed one by one: give
    more to bound the memory of a task.
    """
    parts = shuffle_partitions(bound_batches(docs).sparkSession)
    blocks = blocks or BLOCKS_PER_PARTITION * parts
    others = [f"`{c}`" for c in docs.columns if c != text_col]
    # rows without an id may be any number: they have blocks -1, -2, ... before all others
    nameless = -1 - F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(blocks)).cast("int")
    block = F.when(F.col(f"`{id_col}`").isNull(), nameless).otherwise(id_blocks(docs, f"`{id_col}`", blocks))
    rows = docs.select(
        block.cast("int").alias("block"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.struct(*others).alias("row"),
    ).repartition(parts, "block")
    # the same columns on both paths, so that Spark writes this exchange once
    sent = rows.mapInArrow(_block_hashes(window, parts), "bucket int, block int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, bits binary, n int")
    return (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_apply(window), with_row(rows, RESULT))
    )


def op4_substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans."""
    found = substring_dedup(docs.select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"), "spans")
