"""SentencePiece encoding and decoding (operator 3): shared-prefix Viterbi.

Texts are marked as the vocabulary wants it (a mark for every blank, one in
front) and cut where no piece can span: between words, and between characters
that no piece has side by side. The distinct marked words of a batch are
sorted, which lists their trie depth-first: a word keeps the forward entries of
the prefix it shares with the word before it, and only its own end is computed.

A forward entry holds the score and the last piece of the best path to a
prefix. Vocabularies whose scores decide (``by_score``) take the path with the
largest sum, of equal sums the one with the longest last piece; a character
that is no piece costs ``UNKNOWN_COST`` more than the least score.

A vocabulary of merges, as the registered query's, is not one of free choice:
there the merges decide, not the sums. A path is allowed only if merging any
two neighbouring pieces' characters by score gives these two pieces again, and
exactly one path to every prefix passes. So ids equal those of the library that
the vocabulary is for, which tests hold over whole tables.

Characters beyond the vocabulary become byte pieces. Decoding joins the pieces,
turns marks into blanks, takes the first blank away, and reads bytes as UTF-8
(a wrong byte becomes U+FFFD).

Defined cases: null and empty texts have no ids and decode to an empty text;
equal rows have equal ids; a word of any length is encoded whole. Other
columns, whatever their names, pass untouched inside ``row``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, with_row

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_RUN = re.compile(f"{MARK}*[^\\W\\d_]+|{MARK}+|[^\\w{MARK}]+|[\\d_]+")
#: Marked words, parts of them, and pairs of pieces a worker remembers at most; beyond it starts anew.
CACHE_WORDS, CACHE_PARTS, CACHE_PAIRS = 50_000, 300_000, 200_000


#: What a character beyond the vocabulary costs beside the least score, where scores decide.
UNKNOWN_COST = 10.0


class Pieces:
    """The pieces of a vocabulary file: numbers, scores, and texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.number = {x: i for i, x in enumerate(names) if not special[i] and not model.is_byte(i)}
        self.score = {x: model.get_score(i) for x, i in self.number.items()}
        self.longest, self.least = max(map(len, self.score), default=1), min(self.score.values(), default=0.0)
        #: Pairs of characters that stand side by side in a piece.
        self.neighbours = {x[i : i + 2] for x in self.number for i in range(len(x) - 1)}
        self.of_byte = {int(x[3:5], 16): i for i, x in enumerate(names) if model.is_byte(i)}
        unknown = " ⁇ ".encode()
        self.raw = [unknown if model.is_unknown(i) else b"" if special[i] else x.replace(MARK, " ").encode() for i, x in enumerate(names)]
        for byte, i in self.of_byte.items():
            self.raw[i] = bytes([byte])
        self.pairs: dict[tuple[str, str], bool] = {}

    def coded(self, piece: str) -> bytes:
        """Id of a piece, or of the bytes of a character that is none."""
        number = self.number.get(piece)
        ids = [self.of_byte[b] for b in piece.encode()] if number is None else [number]
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def cut(self, word: str) -> list[str]:
        """The word, cut between runs of letters, marks, digits and signs where no piece can span."""
        runs = _RUN.findall(word)
        if len(runs) < 2:
            return runs
        out = runs[:1]
        for run in runs[1:]:
            if out[-1][-1] + run[0] in self.neighbours:
                out[-1] += run
            else:
                out.append(run)
        return out

    def merged(self, text: str) -> list[str]:
        """The characters of a short text, merged by the best score, the leftmost of equal ones first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, pair: tuple[str, str]) -> bool:
        """Whether the merges leave two pieces apart, and make each of them; remembered in ``pairs``."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self.merged("".join(pair)) == [p for p in pair if p]
        return found


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts, through forward entries that words with one prefix share."""

    def __init__(self, path: str, by_score: bool = False):
        self.pieces, self.by_score = Pieces(path), by_score
        self.known: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def last_by_score(self, word: str, end: int, total: list[float]) -> tuple[float, str]:
        """The largest sum of a path to word[:end], and its last piece."""
        scores, best = self.pieces.score, (-np.inf, "")
        for start in range(max(0, end - self.pieces.longest), end):
            piece = word[start:end]
            score = scores.get(piece)
            if score is None:
                if start < end - 1:
                    continue
                score = self.pieces.least - UNKNOWN_COST
            if total[start] + score > best[0]:
                best = total[start] + score, piece
        return best

    def paths(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Words in sorted order, a depth-first walk over their trie, with the last pieces of all their prefixes."""
        scores, pairs, agree, before = self.pieces.score, self.pieces.pairs, self.pieces.agree, ""
        last: list[str] = [""]  # the best path's last piece, per prefix
        total = [0.0]  # and its score, where scores decide
        for word in sorted(words):
            shared = len(os.path.commonprefix((before, word)))
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if self.by_score:
                    score, piece = self.last_by_score(word, end, total)
                    total.append(score)
                    last.append(piece)
                    continue
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in scores and start < end - 1:
                        continue  # a single character may be no piece
                    pair = (last[start], piece)
                    allowed = pairs.get(pair)
                    if agree(pair) if allowed is None else allowed:
                        last.append(piece)
                        break
                else:
                    raise ValueError(f"no path to {word[:end]!r}")
            yield word, last
            before = word

    def _learn(self, words: list[str]) -> None:
        for word, last in self.paths(words):
            ids, end = [], len(word)
            while end:
                ids.append(self.pieces.coded(last[end]))
                end -= len(last[end])
            self.known[word] = b"".join(reversed(ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.whole) > CACHE_WORDS:
            self.whole = {}
        if len(self.known) > CACHE_PARTS:
            self.known = {}
        new = {w: self.pieces.cut(w) for w in {w for own in found for w in own}.difference(self.whole)}
        self._learn(list({x for parts in new.values() for x in parts}.difference(self.known)))
        known, whole = self.known, self.whole
        for word, parts in new.items():
            whole[word] = b"".join([known[x] for x in parts])
        return [b"".join([whole[w] for w in own]) for own in found]

    def decode(self, ids: bytes) -> str:
        raw = self.pieces.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return text.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _encoder(path: str, by_score: bool = False) -> WordEncoder:
    """One a worker: what it remembers serves its next tasks."""
    return WordEncoder(path, by_score)


def _others(docs: DataFrame, gone: str) -> DataFrame:
    return bound_batches(docs).select(F.struct(*(f"`{c}`" for c in docs.columns if c != gone)).alias("row"), F.col(f"`{gone}`").alias("value"))


def encode_pieces(docs: DataFrame, vocabulary: str, text_col: str = "text", by_score: bool = False) -> DataFrame:
    """``row`` (a struct of the columns but the text) and ``ids`` (little-endian unsigned 32-bit, binary).

    ``by_score`` is for vocabularies whose scores decide, not merges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, by_score)
        for batch in batches:
            texts, ids = batch.column("value").to_pylist(), []
            for at in range(0, len(texts), 512):
                ids += encoder.encode([t or "" for t in texts[at : at + 512]])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary())], names=["row", "ids"])

    rows = _others(docs, text_col)
    return rows.mapInArrow(run, with_row(rows, "ids binary"))


def decode_pieces(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``row`` (a struct of the columns but the ids), ``ids`` and the ``text`` they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [encoder.decode(ids or b"") for ids in batch.column("value").to_pylist()]
            columns = [batch.column("row"), batch.column("value"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "text"])

    rows = _others(encoded, ids_col)
    return rows.mapInArrow(run, with_row(rows, "ids binary, text string"))


def op3_piece_viterbi(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_chars and sha256 of the text that the ids decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = decode_pieces(encode_pieces(docs.select("doc_id", "text"), path), path)
    return found.select(
        "row.row.doc_id",
        (F.length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
