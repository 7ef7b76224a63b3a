"""The corpus pipeline: every stage against its own input on a small table."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from glmframe.llm.common import read_table
from test_operators import deleted_by_hand, votes_by_hand
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < after.count() <= docs.count() or name == "packing"
        if name != "packing":
            assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
            docs = after
    pieces = after.groupBy("doc_id").sum("length").count()
    assert pieces == docs.count()


def test_packing_stage_writes_ids(spark):
    docs = read_table(spark, SF, "documents").limit(20)
    for r in corpus_pipeline.packing_stage(spark, docs, SF).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (1, words), (1, words), (2, words + " end"), (3, "a b"), (3, "a b"), (3, "other"), (4, "c")]
    rows += [(5, None), (5, None), (None, "n"), (None, "n")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n_chars int")
    out = corpus_pipeline.near_dedup_stage(spark, docs.repartition(3), SF)
    assert out.dtypes == docs.dtypes
    want = [(1, words), (3, "a b"), (3, "other"), (4, "c"), (5, None), (None, "n"), (None, "n")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))


def near_by_hand(rows):
    """Ids of every group's later documents, by all pairs of five-word shingle sets."""
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    sets, parent = {}, {}
    for doc, text in rows:
        words = (text or "").encode().translate(lower).split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d for d in ids if root(d) != d}


def substrings_by_hand(rows):
    """Texts without the words of windows that start earlier; the words that are left, joined by one blank."""
    seen = set()
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        yield doc, b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()


def test_run_equals_five_plain_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 220")
    rows = {r.doc_id: r for r in docs.collect()}
    some = [r for r in rows.values() if r.text and len(r.text.split()) > 60]
    planted = []  # a near copy, a passage within other text, and a repeated line
    for k, r in enumerate(some[:6]):
        words = r.text.split()
        planted.append((1000 + k, " ".join([*words[:-1], "changed"])))
        planted.append((1100 + k, some[-1 - k].text + f"\n{k} more " + " ".join(words[5:40])))
        planted.append((1200 + k, some[10 + k].text + "\nthis very line stands in six of the documents"))
    sample = next(iter(rows.values()))
    extra = spark.createDataFrame([(d, t, sample.lang, sample.source, len(t)) for d, t in planted], docs.schema)
    docs.union(extra).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    texts = {d: r.text for d, r in rows.items()} | dict(planted)
    coded = {d: (t or "").encode() for d, t in texts.items()}
    taught = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5)
    ids = sorted(texts)
    scores = dict(zip(ids, votes_by_hand([coded[d] for d in ids], [coded[d] for d, _ in taught], [float(y) for _, y in taught]), strict=True))
    assert all(abs(x - 0.3) > 2e-3 for x in scores.values())
    one = [(d, texts[d]) for d in ids if scores[d] >= 0.3]
    two = [
        (doc, text if not gone else "\n".join(x for i, x in enumerate(own) if i not in gone))
        for doc, text, own, _, gone in deleted_by_hand(one)
    ]
    three = [(d, t) for d, t in two if d not in near_by_hand(two)]
    four = dict(substrings_by_hand(three))
    assert len(one) < len(ids) and two != one and len(three) < len(two) and any(four[d] != " ".join((t or "").split()) for d, t in three)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in four.items()}
    pieces, windows = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: [i for _, own in sorted(found) for i in own] for d, found in pieces.items()} == want
    for found in windows.values():
        ends = [0, *(a + n for a, n in sorted(found))]
        assert [a for a, _ in sorted(found)] == ends[:-1] and ends[-1] <= 2048
