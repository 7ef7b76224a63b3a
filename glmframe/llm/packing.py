"""Packing (operator 8): bounded-space online packing of token ids into windows.

Each partition encodes its documents one after another and keeps a fixed
number of open windows. Full windows are cut from a document at once; what is
left of it goes into the open window that it fills best. Where none has room,
the fullest open window is filled up with the piece's head and emitted, so it
needs no padding, and the rest opens a new window. When a partition ends, its
open windows are its leftovers. Leftovers of neighbouring partitions are
packed again by the same rule, ``MERGE`` partitions at a time, until one group
is left; the last windows that stay unfilled there are emitted in lengths that
are powers of two, which need no padding, as far as these are at least
``LEAST_TAIL`` long.

Ids that tokenizers give to a text are those of its parts between blanks, one
after another: this vocabulary drops white space before it merges anything.
So every distinct part is encoded once, and looked up afterwards.

Defined cases: a null or empty text is one piece that holds the closing id
alone; equal rows are packed one by one; an empty table gives no rows. Only
the id column and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, checkpointed
from glmframe.llm.merges import CACHE_PIECES, Merges, check_rules

WINDOW = 2048
CLOSING_ID = 1
OPEN_WINDOWS = 16
#: Partitions (later: groups) whose leftovers are packed together.
MERGE = 32
LEAST_TAIL = 64
#: Distinct parts whose ids a worker gathers; beyond it starts anew, and keeps those before as what it looks up next.
CACHE_PARTS = 160_000
PIECE = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, slot long"
)


# The rules that texts are split by here; a vocabulary with others is refused.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Signs that are a piece of their own behind a word.
_STOPS = ".,;:!?"
#: How the vocabulary splits lower-case Latin text.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\w\s])+")


class PartEncoder:
    """Little-endian unsigned 32-bit ids of texts, through bounded caches of parts between blanks and of pieces."""

    def __init__(self, path: str):
        self.merges = Merges(path, NORMALIZER, PRE_TOKENIZER)
        #: Whether letters and stops mean nothing but themselves: no token that is looked for before the split begins so.
        self.simple = all(self.merges.plain(ch) for ch in string.ascii_letters + _STOPS)
        self.parts: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        #: What was known before the caches last started anew: a common part is never encoded again.
        self.old_parts: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                ids = [t.id for t in self.merges.tokens(piece)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.pieces[piece] = found
        return found

    def _part(self, part: str) -> bytes | None:
        """Ids of a part, None where the library has to split it; a word of letters, or one and a stop, needs no pattern."""
        if self.simple and part.isascii():
            if part.isalpha():
                return self._piece(part.lower())
            if part[-1] in _STOPS and part[:-1].isalpha():
                return self._piece(part[:-1].lower()) + self._piece(part[-1])
        if self.merges.plain(part):
            return b"".join([self._piece(x) for x in _PIECE.findall(part.lower())])
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        own = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.parts) > CACHE_PARTS:
            self.old_parts, self.parts = self.parts, {"": b""}
        if len(self.pieces) > CACHE_PIECES // 2:
            self.old_pieces, self.pieces = self.pieces, {}
        known, old, odd = self.parts, self.old_parts, []
        for part in set().union(*own).difference(known):
            found = old.get(part)
            if found is None:
                found = self._part(part)
            if found is None:
                odd.append(part)
            else:
                known[part] = found
        for part, found in zip(odd, self.merges.whole.encode_batch(odd, add_special_tokens=False), strict=True):
            known[part] = b"".join([i.to_bytes(4, "little") for i in found.ids])
        return [b"".join(map(known.__getitem__, parts)) for parts in own]


@lru_cache(maxsize=1)
def _encoder(path: str) -> PartEncoder:
    """One a worker: what it remembers serves its next tasks."""
    return PartEncoder(path)


class Packer:
    """Open windows of one partition or group; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, open_windows: int, first_sequence: int):
        self.size, self.limit, self.next = size, open_windows, first_sequence
        self.open: list[tuple[int, list[tuple]]] = []  # ids held, pieces
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.next, at, None))
            at += n
        self.next += 1

    def add(self, doc: int, start: int, ids: bytes, total: int) -> None:
        view, at = memoryview(ids), 0  # windows are cut by offset: a long text is copied once
        n = len(ids) // 4
        while n >= self.size:
            self._emit([(doc, start, bytes(view[at : at + 4 * self.size]), total)])
            start, at, n = start + self.size, at + 4 * self.size, n - self.size
        if not n:
            return
        best = max((k for k, (held, _) in enumerate(self.open) if held + n <= self.size), key=lambda k: self.open[k][0], default=None)
        if best is None and len(self.open) >= self.limit:
            held, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            head = self.size - held
            self._emit([*pieces, (doc, start, bytes(view[at : at + 4 * head]), total)])
            start, at, n = start + head, at + 4 * head, n - head
        rest = bytes(view[at:])
        if best is None:
            self.open.append((n, [(doc, start, rest, total)]))
            return
        held, pieces = self.open[best]
        pieces.append((doc, start, rest, total))
        if held + n == self.size:
            self._emit(pieces)
            self.open.pop(best)
        else:
            self.open[best] = (held + n, pieces)

    def leftovers(self, slot: int) -> None:
        """Hands the open windows on: sequence_id numbers them within the slot."""
        for k, (_, pieces) in enumerate(self.open):
            for at, (doc, start, ids, total) in enumerate(pieces):
                self.done.append((doc, start, len(ids) // 4, ids, total, k, at, slot))
        self.open = []

    def close(self, least: int) -> None:
        """Fills the last windows one after another and emits the rest in powers of two."""
        pieces = [p for _, own in sorted(self.open, key=lambda w: -w[0]) for p in own]
        self.open = []
        left = sum(len(p[2]) // 4 for p in pieces)
        while left:
            room = self.size
            while room > left and (room // 2 >= least or left <= room // 2 and room > 1):
                room //= 2
            now: list[tuple] = []
            left -= min(room, left)
            while room and pieces:
                doc, start, ids, total = pieces.pop(0)
                now.append((doc, start, ids[: 4 * room], total))
                if len(ids) > 4 * room:
                    pieces.insert(0, (doc, start + room, ids[4 * room :], total))
                room -= min(room, len(ids) // 4)
            self._emit(now)

    def batch(self) -> pa.RecordBatch:
        names, kinds = zip(*(x.split() for x in PIECE.split(", ")), strict=True)
        done, self.done = self.done, []
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in done], pa.binary() if kind == "binary" else pa.int64()) for j, kind in enumerate(kinds)],
            names=names,
        )


def _first_sequence(round_: int, group: int) -> int:
    """Sequences of a group of a round are numbered within a range of their own."""
    return (round_ << 58) | (group << 32)


def _pack_partition(path: str, size: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        encoder, packer = _encoder(path), Packer(size, open_windows, _first_sequence(0, slot))
        closing = CLOSING_ID.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                some = [t or "" for t in texts[at : at + 512]]
                for doc, coded in zip(ids[at : at + 512], encoder.encode(some), strict=True):
                    packer.add(doc, 0, coded + closing, len(coded) // 4 + 1)
            yield packer.batch()
        packer.leftovers(slot)
        yield packer.batch()

    return run


def _pack_leftovers(round_: int, last: bool, size: int, open_windows: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        (slot,) = key
        slot = slot.as_py()
        packer = Packer(size, open_windows, _first_sequence(round_, slot))
        table = table.sort_by([(c, "ascending") for c in ("slot", "sequence_id", "offset")])
        for row in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add(*row)
        if last:
            packer.close(LEAST_TAIL)
        else:
            packer.leftovers(slot)
        return pa.Table.from_batches([packer.batch()])

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the piece's token ids, as little-endian unsigned 32-bit numbers.
    A window is the ids of one sequence_id, one after another by offset.
    ``vocabulary`` is the path of a tokenizers file with the rules named above
    (any other raises); executors read it too.
    """
    check_rules(vocabulary, NORMALIZER, PRE_TOKENIZER)
    texts = bound_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    now = checkpointed(texts.mapInArrow(_pack_partition(vocabulary, size, open_windows), PIECE))
    done = [now.where("slot is null")]
    groups, round_ = now.rdd.getNumPartitions(), 0
    while groups:
        groups, round_ = -(-groups // MERGE) if groups > 1 else 0, round_ + 1
        open_ = now.where("slot is not null").withColumn("group", F.expr(f"slot div {MERGE}"))
        now = checkpointed(
            open_.groupBy("group").applyInArrow(_pack_leftovers(round_, groups <= 1, size, open_windows), PIECE)
        )
        done.append(now.where("slot is null"))
        if groups <= 1:
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.drop("slot")


def pack_words(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, with their ids in the lower-case word vocabulary."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(docs: DataFrame) -> DataFrame:
    """The pieces of all documents, with a checksum in place of the ids."""
    return pack_words(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
