"""Alignment, language model and manifest against brute force on small fixtures with every odd row."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glmframe.llm import lm_scoring as lm
from glmframe.llm import merkle_manifest as mm
from glmframe.llm import token_alignment as ta
from glmframe.llm.blocks import packed, sums, unpacked
from test_operators import SCHEMA, clashing, odd_docs, random_texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(3).persist()


def by_text(rows):
    return sorted(map(str, rows))


# ----------------------------------------------------------------- alignment
def test_shared_cuts():
    rnd = random.Random(1)
    for _ in range(3000):
        n = rnd.randint(1, 40)
        a, b = (sorted({n, *(rnd.randint(1, n) for _ in range(rnd.randint(0, n)))}) for _ in "ab")
        assert ta.shared_cuts(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]
    long = list(range(2, 200_001, 2))
    assert ta.shared_cuts(long, [*range(1, 200_000, 2), 200_000]) == [(len(long) - 1, 100_000)]


def alignment_by_hand(texts):
    """Per text: ids of A, ids of B, groups as text, links; whole texts through the libraries."""
    path = public_tokenizers.path
    library, whole = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    al = ta.Aligner(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    for text in texts:
        a, b = whole.encode(" " + (text or ""), add_special_tokens=False).ids, library.encode(text or "")
        raw_a, raw_b = [al.bytes_a[i] for i in a], [al.bytes_b[i] for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            yield [], [], "", []
            continue
        ends_a, ends_b = ({e: k + 1 for k, e in enumerate(accumulate(map(len, raw)))} for raw in (raw_a, raw_b))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            groups.append(",".join(map(str, a[i : ends_a[end]])) + "|" + ",".join(map(str, b[j : ends_b[end]])))
            i, j = ends_a[end], ends_b[end]
            links.append((a[i - 1], b[j - 1]))
        yield a, b, ";".join(groups), links


def want_alignment(rows):
    found = list(alignment_by_hand(t for _, t in rows))
    count = Counter(x for *_, links in found for x in links)
    most: dict = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    for (doc, _), (a, b, groups, links) in zip(rows, found, strict=True):
        best, total = sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        yield doc, len(a), len(b), len(links), len(links), best, total, digest


def test_token_alignment(spark, docs):
    got = ta.op11_token_alignment(docs)
    assert by_text(map(tuple, got.collect())) == by_text(want_alignment(odd_docs()))
    path = public_tokenizers.path
    found, pairs = ta.align(clashing(docs), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    assert found.columns == [x.split()[0] for x in ta.RESULT.split(", ")] and found.count() == len(odd_docs())
    count = Counter(x for *_, links in alignment_by_hand(t for _, t in odd_docs()) for x in links)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == count
    assert ta.op11_token_alignment(docs.limit(0)).count() == 0


def test_token_alignment_of_odd_characters(spark, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_BYTES", 2000)
    rows = list(enumerate(random_texts(1500) + ["a▁b", "▁", "ends in two  ", "tab\t x", "日本語" * 500]))
    got = ta.op11_token_alignment(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert by_text(map(tuple, got.collect())) == by_text(want_alignment(rows))


# ------------------------------------------------------------------- scoring
def tokens_of(text):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    return [*(text or "").encode().translate(lower).split(), None]


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 == 2


def test_lm_scores(spark, docs):
    rows, classes = odd_docs(), 40
    count = Counter(w for doc, text in rows if not held(doc) for w in tokens_of(text))
    n, v = sum(count.values()), len(count)
    is_held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = lm.lm_scores(clashing(docs), is_held, classes=classes, width=8).collect()
    want = []
    for doc, text in rows:
        own = tokens_of(text)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        want.append((str(doc), held(doc), len(own), sum(count[w] > 0 for w in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = {round(r.score, 4) for r in got if r.doc_id == 901}
    assert len(same) == 1
    assert lm.op12_lm_scoring(docs.limit(0)).count() == 0
    unlearned = lm.lm_scores(docs, F.lit(True), classes=classes, width=8).collect()
    assert {(r.train_tokens, r.n_known, r.base_score) for r in unlearned} == {(0, 0, 0.0)}


def test_scores_equal_a_plain_softmax_and_add_up_to_one():
    rnd = np.random.default_rng(3)
    counts = np.array([5, 40, 9, 1, 30.0])
    model = lm.Model(counts, 6)
    model.put(rnd.standard_normal(len(model.flat())))
    stream = np.array([2, 1, 3, 0, 0, 4, 4, 1, 0], dtype=np.int32)
    near, far = lm.contexts_of(stream)
    assert near.tolist() == [0, 2, 1, 3, 0, 0, 4, 4, 1] and far.tolist() == [0, 0, 2, 1, 0, 0, 0, 4, 4]
    p = model.parts
    scores = (p["context"][near] * p["place"][0] + p["context"][far] * p["place"][1]) @ p["word"].T + p["bias"]
    plain = np.exp(scores.astype(float)) / np.exp(scores.astype(float)).sum(axis=1, keepdims=True)
    got = np.exp(model.log_probabilities(near, far, stream))
    assert np.allclose(got, plain[np.arange(len(stream)), stream], rtol=1e-4)
    every = [np.exp(model.log_probabilities(np.full(5, a), np.full(5, b), np.arange(5))).sum() for a in range(5) for b in range(5)]
    assert np.allclose(every, 1)


def test_training_gradient_and_likelihood():
    """A step goes up the noise-contrastive objective, and training learns which word follows which."""
    rnd = np.random.default_rng(5)
    stream = np.array([w for k in rnd.integers(3, size=4000).tolist() for w in (1 + k, 4 + k, 0)], dtype=np.int32)
    counts = np.bincount(stream, minlength=8).astype(float)
    model = lm.Model(counts, 8)
    near, far = lm.contexts_of(stream)
    before = model.log_probabilities(near, far, stream).mean()
    trainer = lm.Trainer(model, counts, 1)
    for _ in range(5):
        trainer.learn(stream)
    after = model.log_probabilities(near, far, stream).mean()
    assert after > before + 0.5 and after > -np.log(3) / 3 - 0.25  # the best is the choice of the first word


def test_held_out_texts_gain_from_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.op12_lm_scoring(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.995 * r[1]


def test_copies_of_the_model_are_averaged(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "MERGE", 2)
    is_held = F.lit(False)
    got = lm.lm_scores(docs.where("length(text) < 3000").repartition(5), is_held, classes=20, width=4, rounds=2).collect()
    assert all(math.isfinite(r.score) for r in got)


def test_blocks_of_codes():
    for codes in ([], [0], [1, 2**32 - 1, 7] * 1000):
        assert unpacked(packed(np.array(codes, dtype=np.uint32))).tolist() == codes
    assert sums(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [0, 3, 0, 3, 0]


# ------------------------------------------------------------------ manifest
def tree_of(leaves):
    """Levels of a tree, the leaves first, digests as hex."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + 3]).encode()).hexdigest() for i in range(0, len(last), 3)])
    return levels


def postorder(levels):
    """(level, index) of every node, children before their parent."""

    def walk(level, i):
        if level:
            for k in range(3 * i, min(3 * i + 3, len(levels[level - 1]))):
                yield from walk(level - 1, k)
        yield level, i

    return list(walk(len(levels) - 1, 0))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 82, 100])
def test_positions(n):
    levels = tree_of(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))
    assert mm.height(n) == len(levels) - 1
    for place, (level, i) in enumerate(postorder(levels)):
        assert mm.position(level, i, n) == place
        assert mm.position(level, i, min((i + 1) * 3**level, n)) == place


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    return hashlib.sha256("".join(map(field, row)).encode()).hexdigest()


def manifest_rows():
    rnd = random.Random(9)
    sources = ["b", "a", None, "", "é", "big"]
    rows = []
    for i in range(160):
        source = "big" if i % 3 else rnd.choice(sources)
        text = rnd.choice([None, "", f"line {i}\nmore\n", "É" * 40, "no newline", "\n"])
        rows.append((i, source, rnd.choice(["en", None]), rnd.choice([None, i]), text))
    rows += [(7, "big", "en", 7, "same id"), (7, "big", "en", 7, "same id"), (None, "a", None, None, "x\ny"), (None, "alone", None, None, None)]
    rnd.shuffle(rows)
    return rows


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


def want_manifest(rows):
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(((r, leaf_of(r)) for r in trees[s]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in keys}
    levels = {s: tree_of(h for _, h in own[s]) for s in keys}
    top = tree_of(levels[s][-1][0] for s in keys)
    for k, s in enumerate(keys):
        for i, (r, leaf) in enumerate(own[s]):
            shown, proof = leaf, []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = leaf_of((*r[:4], r[4].replace("\n", "")))
            for place, tree in ((i, levels[s]), (k, top)):
                for level in tree[:-1]:
                    run = range(place // 3 * 3, min(place // 3 * 3 + 3, len(level)))
                    proof += [level[j] for j in run if j != place]
                    shown = hashlib.sha256("".join(shown if j == place else level[j] for j in run).encode()).hexdigest()
                    place //= 3
            digest = hashlib.sha256("".join(proof).encode()).hexdigest()
            yield r[0], leaf, levels[s][-1][0], top[-1][0], digest, shown, shown == top[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels, monkeypatch):
    rows = manifest_rows()
    monkeypatch.setattr(mm.manifest, "__defaults__", (levels,))
    df = spark.createDataFrame(rows, MANIFEST).repartition(4)
    got = mm.op13_merkle_manifest(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("tree", "index", "slot", "at", "other", "a.b"))]))
    assert by_text(map(tuple, got.collect())) == by_text(want_manifest(rows))
    assert mm.op13_merkle_manifest(df.limit(0)).count() == 0


def test_whole_log_is_in_postorder(spark):
    digests = {t: [hashlib.sha256(f"{t}{i}".encode()).hexdigest() for i in range(n)] for t, n in (("x", 100), ("y", 1), ("z", 9))}
    rows = [(t, i, None, None, bytes.fromhex(h)) for t, own in digests.items() for i, h in enumerate(own)]
    leaves = spark.createDataFrame(rows, "tree string, index long, id long, other binary, digest binary")
    log = mm.whole_log(mm.append_logs(leaves, 2), 2).collect()
    for t, own in digests.items():
        levels = tree_of(own)
        want = [(k, level, i, levels[level][i]) for k, (level, i) in enumerate(postorder(levels))]
        assert sorted((r.position, r.level, r["index"], r.digest.hex()) for r in log if r.tree == t) == want


def test_one_source_spreads_over_builders(spark, monkeypatch):
    """A tree larger than a block is built in blocks, and its sizes never meet in one group."""
    df = spark.range(0, 400).select(F.lit("t").alias("tree"), "id", F.lit(None).cast("binary").alias("other"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    rounds = mm.append_logs(mm.ranked(df, 5), 2)
    assert len(rounds) == 3 and rounds[0].groupBy("tree", "block").count().agg(F.max("count")).first()[0] == 13
    want = tree_of(hashlib.sha256(str(i).encode()).hexdigest() for i in range(400))[-1][0]
    assert [r.digest.hex() for r in mm.tree_roots(rounds).collect()] == [want]


def test_manifest_sql(spark):
    rows = [r for r in manifest_rows() if r[0] not in (7, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert by_text(con.execute(mm.OP13_SQL).fetchall()) == by_text(want_manifest(rows))
