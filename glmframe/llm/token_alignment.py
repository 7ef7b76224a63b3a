"""Cross-tokenizer alignment (operator 11): divide and conquer at shared cuts.

Two vocabularies split the same bytes into tokens. An interval of the text that
ends a token in both is divided at a common end near its middle, which is
looked for from the middle of one side's ends by bisection in the other's; both
halves are divided on, and an interval without a common end inside is a group.
The tokens that end a group are a link. How often a pair of ids is linked in
all texts tells good links from chance ones.

1. White space gives cuts that both vocabularies' rules make in any text: a
   text is divided there first. Its parts are distinct words mostly, and each
   is encoded and divided once per worker, then looked up.
2. A block of texts is written as its parts' numbers, with one dictionary of
   the parts' links and one of the linked pairs and their counts.
3. The pairs of all blocks are counted by pair, and the best count per B id
   (one row per id of the vocabulary) is joined to them. A pair has one row
   per block that holds it, however common it is.
4. Each block meets the counts of its own pairs, and sums them per text.

Defined cases: null and empty texts, and texts whose tokens do not join to the
same bytes in both vocabularies (those with U+2581), have no tokens: all
numbers are 0 and the digest is empty; equal rows count one by one; a null id
is kept. Only the id and text columns are read.
"""

from __future__ import annotations

import gc
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.blocks import BLOCK_BYTES, block_number, packed, sums, unpacked
from glmframe.llm.common import bound_batches, checkpointed
from glmframe.llm.merges import CACHE_PIECES, Merges, byte_alphabet

#: Unicode white space but the blank and the newline, the only ones that both vocabularies always cut before
#: (fixed values).
_TIED = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f" \n{_TIED}"
_PART = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:[{_TIED}][{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")
#: How the byte-level vocabulary splits Latin text.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\w\s])+|\s+(?!\S)|\s+")
MARK = "▁"
#: Distinct parts a worker remembers at most; beyond it closes its block and starts anew.
CACHE_PARTS = 400_000
BLOCK = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, links binary,"
    " pair array<long>, n array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def shared_cuts(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int]]:
    """Numbers (i, j) of all tokens that end together, ascending; both sides' last tokens must.

    An interval is searched from the middle of A's ends outwards.
    """
    found, stack = [], [(0, len(ends_a) - 1, 0, len(ends_b) - 1)]
    while stack:
        a, last_a, b, last_b = stack.pop()
        i = j = -1
        if a < last_a and b < last_b:
            up = (a + last_a) // 2
            down = up - 1
            while up < last_a or down >= a:
                if up < last_a:
                    at = bisect_left(ends_b, ends_a[up], b, last_b)
                    if at < last_b and ends_b[at] == ends_a[up]:
                        i, j = up, at
                        break
                    up += 1
                if down >= a:
                    at = bisect_left(ends_b, ends_a[down], b, last_b)
                    if at < last_b and ends_b[at] == ends_a[down]:
                        i, j = down, at
                        break
                    down -= 1
        if i < 0:
            found.append((last_a, last_b))
        else:  # the left half comes off the stack first
            stack.append((i + 1, last_a, j + 1, last_b))
            stack.append((a, i, b, j))
    return found


class Aligner:
    """Parts of texts in both vocabularies, aligned once each.

    ``known`` numbers the distinct parts; per number there are the counts of
    tokens, whether they join to the part, the groups as text, and the links
    (numbers in ``pairs``).
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        value = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = token.encode() if token in special else bytes(value[c] for c in token)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.mark = self.b.piece_to_id(MARK)
        self.merges = Merges(path_a)
        self.text_a, self.text_b = {i: str(i) for i in self.bytes_a}, [str(i) for i in range(len(self.bytes_b))]
        self.size_a, self.size_b = {i: len(x) for i, x in self.bytes_a.items()}, [len(x) for x in self.bytes_b]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.n_a, self.n_b, self.valid = array("q"), array("q"), array("b")
        self.groups: list[str] = []
        self.links: list[tuple[int, ...]] = []
        self.pairs: dict[int, int] = {}
        self.pieces: dict[str, list[int]] = {}

    def encode_a(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts: plain Latin ones by their pieces, which are fewer, the rest through the whole library."""
        pieces, odd, out = self.pieces, [], []
        if len(pieces) > CACHE_PIECES:
            pieces.clear()
        for part in parts:
            if not self.merges.plain(part):
                odd.append(len(out))
                out.append([])
                continue
            ids: list[int] = []
            for piece in _PIECE.findall(part):
                own = pieces.get(piece)
                if own is None:
                    own = pieces[piece] = [t.id for t in self.merges.tokens(piece)]
                ids += own
            out.append(ids)
        for k, coded in zip(odd, self.a.encode_batch([parts[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = coded.ids
        return out

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """Ids as within a text: the library's own first mark stands for a part's first blank."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        for k, part in enumerate(parts):
            if part == " ":
                found[k] = [self.mark]
            elif part[0] != " ":
                if found[k][:1] != [self.mark]:
                    raise ValueError(f"the vocabulary joins a mark and {part[0]!r}: parts aren't cut there")
                found[k] = found[k][1:]
        return found

    def learn(self, parts: list[str]) -> None:
        bytes_a, bytes_b, size_a, size_b = self.bytes_a, self.bytes_b, self.size_a, self.size_b
        text_a, text_b, pairs = self.text_a, self.text_b, self.pairs
        for part, a, b in zip(parts, self.encode_a(parts), self.encode_b(parts), strict=True):
            raw = part.encode()
            self.known[part] = len(self.groups)
            if b"".join([bytes_a[i] for i in a]) != raw or b"".join([bytes_b[i] for i in b]) != raw:
                self.n_a.append(0)
                self.n_b.append(0)
                self.valid.append(0)
                self.groups.append("")
                self.links.append(())
                continue
            if len(a) == 1 or len(b) == 1:
                cuts = [(len(a) - 1, len(b) - 1)]
            else:
                cuts = shared_cuts(list(accumulate([size_a[i] for i in a])), list(accumulate([size_b[i] for i in b])))
            texts, links, at_a, at_b = [], [], 0, 0
            for i, j in cuts:
                links.append(pairs.setdefault(a[i] << 32 | b[j], len(pairs)))
                if at_a == i and at_b == j:
                    texts.append(f"{text_a[a[i]]}|{text_b[b[j]]}")
                else:
                    texts.append(",".join([text_a[x] for x in a[at_a : i + 1]]) + "|" + ",".join([text_b[x] for x in b[at_b : j + 1]]))
                at_a, at_b = i + 1, j + 1
            self.n_a.append(len(a))
            self.n_b.append(len(b))
            self.valid.append(1)
            self.groups.append(";".join(texts))
            self.links.append(tuple(links))

    def codes(self, texts: list[str | None]) -> list[list[int]]:
        """The numbers of each text's parts, those of the text after a blank; none without tokens."""
        parts = [_PART.findall(" " + t) if t else [] for t in texts]
        new = {p for own in parts for p in own}.difference(self.known)
        if new:
            self.learn(list(new))
        known = self.known
        return [[known[p] for p in own] for own in parts]


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker: what it remembers serves its next tasks."""
    return Aligner(path_a, path_b)


class _Block:
    """The texts of a block, until it is written."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.digests: list[str] = []
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, aligner: Aligner, ids: list, texts: list[str | None]) -> None:
        self.ids += ids
        codes = aligner.codes(texts)
        groups = aligner.groups
        for own in codes:
            self.digests.append(sha256(";".join([groups[i] for i in own]).encode()).hexdigest() if own else "")
            self.codes.append(np.array(own, dtype=np.uint32))
        self.bytes += sum(len(t) for t in texts if t)

    def batch(self, aligner: Aligner, number: int) -> pa.RecordBatch:
        """One row with the dictionaries, and one per text."""
        n, cuts = len(self.ids), np.cumsum([0, *map(len, self.codes)])
        joined = np.concatenate(self.codes)
        # a text with a part that fails has no tokens
        valid = sums(1 - np.frombuffer(aligner.valid, dtype=np.int8).astype(np.int64)[joined], cuts) == 0
        valid &= np.diff(cuts) > 0
        joined = joined[np.repeat(valid, np.diff(cuts))]
        cuts = np.cumsum([0, *np.where(valid, np.diff(cuts), 0).tolist()])
        n_links = np.fromiter(map(len, aligner.links), dtype=np.int64, count=len(aligner.links))
        counts = [sums(np.array(x, dtype=np.int64)[joined], cuts) for x in (aligner.n_a, aligner.n_b, n_links)]

        used = np.bincount(joined, minlength=len(aligner.groups))
        parts = np.flatnonzero(used)
        renumber = np.zeros(len(used), dtype=np.uint32)
        renumber[parts] = np.arange(len(parts))
        codes, sizes = renumber[joined], n_links[parts]
        linked = np.fromiter((x for i in parts.tolist() for x in aligner.links[i]), dtype=np.int64, count=int(sizes.sum()))
        times = np.bincount(linked, np.repeat(used[parts], sizes), minlength=len(aligner.pairs)).astype(np.int64)
        pairs = np.flatnonzero(times)
        small = np.zeros(len(aligner.pairs), dtype=np.uint32)
        small[pairs] = np.arange(len(pairs))
        values = np.fromiter(aligner.pairs, dtype=np.int64, count=len(aligner.pairs))
        columns = [
            pa.array([number] * (n + 1), pa.int64()),
            pa.array([None, *self.ids], pa.int64()),
            *(pa.array([None, *c.tolist()], pa.int64()) for c in counts),
            pa.array([None, *(d if v else "" for d, v in zip(self.digests, valid.tolist(), strict=True))], pa.string()),
            pa.array([packed(sizes), *(packed(codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))], pa.binary()),
            pa.array([packed(small[linked]), *[None] * n], pa.binary()),
            pa.array([values[pairs], *[None] * n], pa.list_(pa.int64())),
            pa.array([times[pairs], *[None] * n], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])


def _encode(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, sequence = TaskContext.get().partitionId(), 0
        aligner, block = _aligner(path_a, path_b), _Block()
        gc.freeze()  # many small objects that live long, none in a cycle
        gc.disable()
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                block.add(aligner, ids[at : at + 256], texts[at : at + 256])
                if block.bytes > BLOCK_BYTES or len(aligner.known) > CACHE_PARTS:
                    yield block.batch(aligner, block_number(slot, sequence))
                    block, sequence = _Block(), sequence + 1
                    if len(aligner.known) > CACHE_PARTS:
                        aligner.clear()
        if block.ids:
            yield block.batch(aligner, block_number(slot, sequence))

    return run


def _sum(key: tuple, block: pa.Table, counted: pa.Table) -> pa.Table:
    """The numbers of a block's texts from the counts of its pairs."""
    head = block.filter(pa.compute.is_valid(block.column("links")))
    texts = block.filter(pa.compute.is_null(block.column("links")))
    codes = [unpacked(c) for c in texts.column("codes").to_pylist()]
    cuts = np.cumsum([0, *map(len, codes)])
    joined = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint32)
    sizes, links = unpacked(head.column("codes")[0].as_py()), unpacked(head.column("links")[0].as_py())
    ends = np.cumsum([0, *sizes.tolist()])
    totals = []
    for name in ("best", "count"):
        value = np.zeros(counted.num_rows, dtype=np.int64)
        value[counted.column("pos").to_numpy()] = counted.column(name).to_numpy()
        totals.append(sums(sums(value[links], ends)[joined], cuts))
    own = [texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
    columns = [*own, texts.column("n_groups"), *map(pa.array, totals), texts.column("groups_sha256")]
    return pa.table(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two frames: one row per text (``RESULT``), and (a, b, count, best) of every linked pair of ids.

    ``path_a`` is a byte-level tokenizers file without a normalizer, ``path_b``
    a sentencepiece model that turns blanks into marks and adds one in front;
    A gets a blank in front too. ``best`` is 1 where no pair with that B id is
    counted more often.
    """
    rows = bound_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    blocks = checkpointed(rows.mapInArrow(_encode(path_a, path_b), BLOCK))
    own = blocks.where("pair is not null").select("block", F.posexplode(F.arrays_zip("pair", "n")).alias("pos", "p"))
    own = own.select(F.col("block").alias("owner"), "pos", "p.pair", "p.n")
    totals = own.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # one row per id of vocabulary B
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    pairs = totals.join(F.broadcast(most), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    pairs = checkpointed(pairs)
    counted = own.join(pairs, "pair").select("owner", "pos", "count", "best")
    found = blocks.groupBy("block").cogroup(counted.groupBy("owner")).applyInArrow(_sum, RESULT)
    return found, pairs.select(F.shiftright("pair", 32).alias("a"), "b", "count", "best")


def op11_token_alignment(docs: DataFrame) -> DataFrame:
    """Groups, links and their counts of every document, byte-level against piece vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path
    return align(docs.select("doc_id", "text"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))[0]
