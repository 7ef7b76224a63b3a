"""LM scoring (operator 12): a log-bilinear model, trained by noise-contrastive estimation.

The score of a word after two others is the product of its own vector with a
predicted one, a sum of the context words' vectors weighted by place, plus a
bias. Training tells a text's words from noise drawn by word frequency, a batch
of words against one set of noise words per matrix product, and never
normalises. Scoring does: the products with all words' vectors give the sum
over the vocabulary, once per distinct context of a block of texts.

1. Each block of texts is written once as numbers of its own words, with the
   block's dictionary and its counts in training texts.
2. The dictionaries of all blocks are counted by word: every word of the
   corpus has its count, one row per block and word, however common it is.
3. The ``classes`` most frequent words have vectors of their own; an end of
   text has too, and the rest share one. Blocks are passed over ``rounds``
   times: each partition trains a copy of the model on all its training texts,
   and the copies' mean, weighted by words and added up in groups of ``MERGE``,
   is the next model.
4. Each block meets its words' counts and is scored. A word of the rest has
   the rest's probability times its own share there, (count + 1) of the sum of
   these; all words that training texts lack have one share together, a count
   of 0. So the probabilities of every context add up to 1.

The model's size is bounded by ``classes``; only it and the classes' hashes are
sent whole to tasks. Words are compared by 64-bit hashes.

Defined cases: a null, empty or blank text is one token, its end; equal rows
count one by one; a text with a null id is held out, so it is never learned
from; without training texts all words share one unseen count, and scores are
those of a model without training. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glmframe.llm.blocks import BLOCK_BYTES, block_number, packed, sums, unpacked
from glmframe.llm.common import bound_batches, checkpointed, slices, utf8, words_of
from glmframe.session import scratch_path

CLASSES = 1024
WIDTH = 32
ROUNDS = 1
BATCH, NOISE, RATE = 1024, 64, 0.2
#: Models that are added up together.
MERGE = 32
#: The end of a text: its hash among the words', and its class; the rest's class comes after all words'.
END = 0
BLOCK = "block long, doc_id long, held_out boolean, n_tokens long, codes binary, hash array<long>, n array<int>"
MODEL = "slot long, weight double, model binary"
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


# --------------------------------------------------------------------- model
class Model:
    """Vectors of context words and of predicted words, weights of the two places, and biases."""

    def __init__(self, counts: np.ndarray, width: int = WIDTH, seed: int = 12):
        random = np.random.Generator(np.random.PCG64(seed))
        size = len(counts)
        share = (counts + 1.0) / (counts + 1.0).sum()
        self.parts = {
            "context": (random.standard_normal((size, width)) * 0.3).astype(np.float32),
            "word": np.zeros((size, width), dtype=np.float32),
            "place": np.ones((2, width), dtype=np.float32),
            "bias": np.log(share).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def put(self, flat: np.ndarray) -> Model:
        at = 0
        for name, p in self.parts.items():
            self.parts[name] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def predicted(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The vector that a context of the word before and the one before that speaks for."""
        context, place = self.parts["context"], self.parts["place"]
        return context[near] * place[0] + context[far] * place[1]

    def log_probabilities(self, near: np.ndarray, far: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all classes; the sum once per distinct context."""
        vectors, bias = self.parts["word"], self.parts["bias"]
        size = len(bias)
        contexts, which = np.unique(far.astype(np.int64) * size + near, return_inverse=True)
        total = np.empty(len(contexts))
        for at in range(0, len(contexts), 2048):
            some = contexts[at : at + 2048]
            scores = self.predicted(some % size, some // size) @ vectors.T + bias
            top = scores.max(axis=1, keepdims=True)
            total[at : at + 2048] = np.log(np.exp(scores - top).sum(axis=1, dtype=np.float64)) + top[:, 0]
        out = np.empty(len(word))
        for at in range(0, len(word), 65536):
            part = slice(at, at + 65536)
            own = np.einsum("ij,ij->i", self.predicted(near[part], far[part]), vectors[word[part]])
            out[part] = own.astype(np.float64) + bias[word[part]]
        return out - total[which]


def contexts_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token of texts that each close with END: the token before it and the one before that, END before a text."""
    near = np.concatenate([[END], stream[:-1]]).astype(stream.dtype)
    far = np.concatenate([[END], near[:-1]]).astype(stream.dtype)
    far[near == END] = END
    return near, far


def _add_rows(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, steps: np.ndarray, rate: float) -> None:
    """An AdaGrad step for some rows of a table, those that repeat added up."""
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    total = np.add.reduceat(steps[order], first, axis=0)
    own = own[first]
    squares[own] += np.square(total).mean(axis=1)
    table[own] += (rate / np.sqrt(squares[own]))[:, None] * total


class Trainer:
    """One partition's copy of the model."""

    def __init__(self, model: Model, counts: np.ndarray, seed: int, rate: float = RATE):
        self.model, self.rate = model, rate
        self.random = np.random.Generator(np.random.PCG64(seed))
        share = (counts + 1.0) / (counts + 1.0).sum()
        self.cumulative = np.cumsum(share)
        self.cumulative[-1] = 1.0
        #: Expected number of noise words of each class per true one, as a logarithm.
        self.noise = np.log(NOISE * share).astype(np.float32)
        self.squares = {name: np.full(len(p), 0.1, dtype=np.float32) for name, p in model.parts.items()}

    def learn(self, stream: np.ndarray) -> None:
        near, far = contexts_of(stream)
        order = self.random.permutation(len(stream))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self._step(near[some], far[some], stream[some])

    def _step(self, near: np.ndarray, far: np.ndarray, word: np.ndarray) -> None:
        parts, squares, rate = self.model.parts, self.squares, self.rate
        context, vectors, place, bias = (parts[x] for x in ("context", "word", "place", "bias"))
        noise = np.searchsorted(self.cumulative, self.random.random(NOISE), side="right")
        one, two = context[near], context[far]
        predicted = one * place[0] + two * place[1]
        own, other = vectors[word], vectors[noise]
        # probability that a word is taken for noise, or noise for a word
        true = np.einsum("ij,ij->i", predicted, own) + bias[word] - self.noise[word]
        false = predicted @ other.T + (bias[noise] - self.noise[noise])
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        back = up[:, None] * own + down @ other
        rows = np.concatenate([word, noise])
        steps = np.concatenate([up[:, None] * predicted, down.T @ predicted])
        biases = np.concatenate([up, down.sum(axis=0)])
        _add_rows(vectors, squares["word"], rows, steps, rate)
        _add_rows(bias[:, None], squares["bias"], rows, biases[:, None], rate)
        _add_rows(context, squares["context"], np.concatenate([near, far]), np.concatenate([back * place[0], back * place[1]]), rate)
        for k, side in enumerate((one, two)):
            step = (back * side).mean(axis=0)
            squares["place"][k] += np.square(step).mean()
            place[k] += 0.1 * rate / np.sqrt(squares["place"][k]) * step


# -------------------------------------------------------------------- blocks
def _block(number: int, texts: list[tuple], hashes: list[np.ndarray]) -> pa.RecordBatch:
    """One row with the dictionary, and one per text."""
    words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
    cuts = np.cumsum([0, *map(len, hashes)])
    doc, held = zip(*texts, strict=True)
    learned = np.repeat(~np.array(held), np.diff(cuts))
    counts = np.bincount(codes[learned], minlength=len(words))
    # frequent words get small numbers
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    renumber = np.empty(len(words), dtype=np.uint32)
    renumber[order] = np.arange(len(words))
    codes = renumber[codes]
    n = len(texts)
    columns = [
        pa.array([number] * (n + 1), pa.int64()),
        pa.array([None, *doc], pa.int64()),
        pa.array([None, *held], pa.bool_()),
        pa.array([None, *np.diff(cuts).tolist()], pa.int64()),
        pa.array([None, *(packed(codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))], pa.binary()),
        pa.array([words[order].view(np.int64), *[None] * n], pa.list_(pa.int64())),
        pa.array([counts[order].astype(np.int32), *[None] * n], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slot, sequence, size = TaskContext.get().partitionId(), 0, 0
    end = np.array([END], dtype=np.uint64)
    rows: list[tuple] = []
    hashes: list[np.ndarray] = []
    for batch in batches:
        ids, held, texts = batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), utf8(batch.column("text"))
        for a, b in slices(texts):
            _, _, found, first = words_of(texts[a:b], lower=True)
            for k, (begin, stop) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), a):
                rows.append((ids[k], held[k]))
                hashes.append(np.concatenate([found[begin:stop], end]))
                size += len(texts[k])
            if size > BLOCK_BYTES:
                yield _block(block_number(slot, sequence), rows, hashes)
                rows, hashes, sequence, size = [], [], sequence + 1, 0
    if rows:
        yield _block(block_number(slot, sequence), rows, hashes)


# ------------------------------------------------------------------ training
def _classes(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Class of each word hash: END, its place among the ``known`` (sorted) from 1, or the one after these."""
    out = np.full(len(words), len(known) + 1, dtype=np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        out = np.where(known[at] == words, at + 1, out).astype(np.int32)
    out[words == END] = END
    return out


def _train(known: np.ndarray, counts: np.ndarray, flat: np.ndarray, width: int, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = TaskContext.get().partitionId()
        trainer = Trainer(Model(counts, width).put(flat), counts, 1_000_003 * round_ + slot, RATE / (1 + round_))
        classes, weight, streams, waiting = None, 0, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hash", "held_out", "codes")]
            for words, held, codes in zip(*columns, strict=True):
                if words is not None:
                    if streams:
                        trainer.learn(np.concatenate(streams))
                    classes, streams, waiting = _classes(np.array(words, dtype=np.int64), known), [], 0
                elif not held:
                    streams.append(classes[unpacked(codes)])
                    weight += len(streams[-1])
                    waiting += len(streams[-1])
                    if waiting > 1 << 20:
                        trainer.learn(np.concatenate(streams))
                        streams, waiting = [], 0
        if streams:
            trainer.learn(np.concatenate(streams))
        if weight:
            model = trainer.model.flat().astype(np.float32)
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int64()), "weight": pa.array([float(weight)]), "model": pa.array([model.tobytes()], pa.binary())})

    return run


def _mean(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("slot")
    weights = np.array(table.column("weight").to_pylist())
    total = sum(w * np.frombuffer(m, dtype=np.float32).astype(np.float64) for w, m in zip(weights, table.column("model").to_pylist(), strict=True))
    mean = (total / weights.sum()).astype(np.float32).tobytes()
    return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "weight": pa.array([float(weights.sum())]), "model": pa.array([mean], pa.binary())})


def train(blocks: DataFrame, known: np.ndarray, counts: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> np.ndarray:
    """The model after ``rounds`` passes over all blocks, flat."""
    flat, slots = Model(counts, width).flat(), blocks.rdd.getNumPartitions()
    for r in range(rounds):
        copies = checkpointed(blocks.mapInArrow(_train(known, counts, flat, width, r), MODEL))
        left = slots
        while left > 1:
            left = -(-left // MERGE)
            grouped = copies.withColumn("slot", F.expr(f"slot div {MERGE}")).groupBy("slot")
            copies = checkpointed(grouped.applyInArrow(_mean, MODEL))
        found = copies.first()
        if found is None:
            break
        flat = np.frombuffer(bytes(found["model"]), dtype=np.float32)
    return flat


# ------------------------------------------------------------------- scoring
def _score(known: np.ndarray, counts: np.ndarray, flat: np.ndarray, width: int, tokens: int, kinds: int, rest: int):
    """``rest``: the sum of (count + 1) over known words without a class, and 1 for the unseen."""

    def run(key: tuple, block: pa.Table, counted: pa.Table) -> pa.Table:
        texts = block.filter(pa.compute.is_valid(block.column("codes")))
        head = block.filter(pa.compute.is_valid(block.column("hash")))
        words = head.column("hash")[0].values.to_numpy()
        count = np.zeros(len(words), dtype=np.int64)
        count[counted.column("pos").to_numpy()] = counted.column("c").to_numpy()
        classes = _classes(words, known)
        base = np.log10((count + 1.0) / (tokens + kinds + 1.0))
        share = np.where(classes == len(known) + 1, np.log10((count + 1.0) / rest), 0.0)
        codes = [unpacked(c) for c in texts.column("codes").to_pylist()]
        cuts = np.cumsum([0, *map(len, codes)])
        joined = np.concatenate(codes)
        stream = classes[joined]
        near, far = contexts_of(stream)
        own = Model(counts, width).put(flat).log_probabilities(near, far, stream) / np.log(10) + share[joined]
        results = [
            *(texts.column(c) for c in ("doc_id", "held_out", "n_tokens")),
            pa.array(sums((count[joined] > 0).astype(np.int64), cuts)),
            pa.array(np.full(len(codes), tokens)),
            pa.array(sums(base[joined], cuts)),
            pa.array(sums(own, cuts)),
        ]
        return pa.table(results, names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def lm_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: int = CLASSES,
    width: int = WIDTH,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per text: see ``RESULT``; learned from all texts where ``held_out`` is false.

    ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over the tokens,
    ``score`` the model's log10 probability of the text, its end included.
    """
    spark = bound_batches(docs).sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
    )
    blocks = checkpointed(rows.mapInArrow(_encode, BLOCK))
    own = blocks.where("hash is not null").select("block", F.posexplode(F.arrays_zip("hash", "n")).alias("pos", "w"))
    same = Window.partitionBy("hash").orderBy("block")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    path = scratch_path(spark, "lm-counts")
    own.select("block", "pos", "w.hash", F.col("w.n").cast("long").alias("n")).select(
        "block", "pos", "hash", F.sum("n").over(whole).alias("c"), (F.row_number().over(same) == 1).alias("first")
    ).write.parquet(path)
    counted = spark.read.parquet(path)

    # every word once: totals, and the most frequent ones (the end of a text apart)
    words = counted.where("first and c > 0")
    totals = words.agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = totals["tokens"] or 0, totals["kinds"]
    top = words.where(F.col("hash") != END).orderBy(F.col("c").desc(), "hash").limit(classes).select("hash", "c").collect()
    top.sort(key=lambda r: r["hash"])
    known = np.array([r["hash"] for r in top], dtype=np.int64)
    ends = words.where(F.col("hash") == END).select("c").first()
    listed = np.array([ends["c"] if ends else 0, *(r["c"] for r in top)], dtype=np.float64)
    rest = int(tokens - listed.sum()) + (kinds - len(top) - bool(ends)) + 1
    counts = np.append(listed, float(rest))

    flat = train(blocks, known, counts, width, rounds)
    pairs = blocks.groupBy("block").cogroup(counted.select("block", "pos", "c").groupBy("block"))
    return pairs.applyInArrow(_score(known, counts, flat, width, tokens, kinds, rest), RESULT)


def op12_lm_scoring(docs: DataFrame) -> DataFrame:
    """Unigram and model scores of every document; a seventh, by the checksum of the id, is held out."""
    return lm_scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
