"""Training-data operators against brute force on small fixtures with every odd row."""

import bisect
import hashlib
import json
import random
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from glmframe.llm import fingerprints as fp
from glmframe.llm import near_dedup as nd
from glmframe.llm.html_template import extract_main_text, main_text, parse
from glmframe.llm import line_dedup as ld
from glmframe.llm.packing import Packer, PartEncoder, op8_packing, pack
from glmframe.llm.piece_viterbi import WordEncoder, op3_piece_viterbi
from glmframe.llm.quality_knn import NeighbourModel, fit_quality, op1_quality_classifier, score_quality, term_counts
from glmframe.llm.quality_rules import RULES, Rule, order_rules, quality_rules
from glmframe.llm.substring_dedup import op4_substring_dedup, substring_dedup
from glmframe.llm.token_counts import SpanEncoder, attribute, section_token_counts

SCHEMA = "doc_id long, text string"
#: Names that operators use themselves, as extra columns of a table.
CLASHES = ["row", "block", "id", "removed", "n_words", "score", "ids", "a.b"]


def odd_docs():
    """Nulls, empty and long texts, copies, near copies, repeated rows, a null id."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6)))
    base = [[word() for _ in range(90)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base[:6]:  # near copies
        for k in range(3):
            c = list(b)
            c[rnd.randrange(90)] = f"changed{k}"
            texts.append(" ".join(c))
    texts += [texts[0], texts[0], " ".join(base[3][20:70] + base[4][10:60]), "  a b\tc ", "one", "", " \n "]
    texts += [" ".join(w for b in base for w in b) * 20]
    rows = list(enumerate(texts)) + [(900, None), (None, texts[1]), (901, "x y z"), (901, "x y z"), (902, "É" * 3000)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(3).persist()


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_substring_dedup(spark, docs):
    seen, want = set(), []
    for doc, text in ordered(odd_docs()):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:4] for r in op4_substring_dedup(docs).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    extra = substring_dedup(clashing(docs))
    assert extra.select("row.*").columns == ["doc_id", *CLASHES] and extra.count() == len(want)
    assert op4_substring_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, width, percent):
    sets, parent = {}, {}
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    for doc, text in odd_docs():
        words = (text or "").encode().translate(lower).split()
        grams = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets[doc] = frozenset(grams)
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in sets if k is not None)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = sorted((str(d), len(sets[d]), str(None if d is None else root(d))) for d, _ in odd_docs())
    got = nd.near_duplicates(clashing(docs).drop("id"), width=width, percent=percent).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert nd.near_duplicates(docs.limit(0), width=width, percent=percent).count() == 0


def test_odd_sketch_and_bands():
    rnd = np.random.default_rng(1)
    a, b = nd._permutations(nd.BANDS * nd.BAND_ROWS)
    common, more = rnd.integers(0, 1 << 63, 900, dtype=np.uint64), rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
    one, two = np.concatenate([common, more[:100]]), np.concatenate([common, more[100:]])
    sketches = [nd.odd_sketch(nd.minhash(x, a, b)) for x in (one, two)]
    apart = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
    assert abs(nd.odd_estimate(apart, len(a)) - 900 / 1100) < 0.1 and apart <= nd.odd_limit(80, len(a))
    assert nd.miss_probability(0.85) < 1e-10 and nd.miss_probability(0.8) < 1e-8


def test_units_of_two_chunks_lose_no_link(spark, docs, monkeypatch):
    want = sorted((str(r.id), str(r.component_id)) for r in nd.near_duplicates(docs, width=3, percent=85).collect())
    monkeypatch.setattr(nd, "CHUNK_DOCS", 2)
    assert sorted((str(r.id), str(r.component_id)) for r in nd.near_duplicates(docs, width=3, percent=85).collect()) == want


def deleted_by_hand(rows):
    """Per row: its lines, the numbers of those that aren't blank, and of those that repeated runs cover."""
    seen = set()
    for doc, text in ordered(rows):
        own = (text or "").split("\n")
        full = [i for i, x in enumerate(own) if x.strip()]
        gone = set()
        for n in (1, 2, 3):
            for k in range(len(full) - n + 1):
                key = tuple(own[i].strip() for i in full[k : k + n])
                if n == 3 or len(" ".join(key).split()) >= 5:
                    if key in seen:
                        gone |= set(full[k : k + n])
                    seen.add(key)
        yield doc, text, own, full, sorted(gone)


def line_rows():
    rnd = random.Random(2)
    lines = ["A x", "B", "C", " D ", "", "E", "F f", "one two three four five", "  one  two\tthree", "six seven eight nine ten "]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 9)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "A x\nB\nC\nnew"), (None, "A x\nB\nC"), (103, "x"), (104, " \n\n")]
    rows += [(140 + i, f"own {i}\nalone it stands in many texts\nmore {i}") for i in range(3)]
    return rows + [(150, "alone it stands in many texts")]


@pytest.mark.parametrize("hot_keys", [1000, 5])
def test_line_dedup(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(ld, "HOT_KEYS", hot_keys)
    rows, want = line_rows(), []
    for doc, text, own, full, gone in deleted_by_hand(rows):
        left = None if text is None else "\n".join(x for i, x in enumerate(own) if i not in gone)
        want.append((str(doc), str(left), 0 if text is None else len(full), len(gone), str(gone)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = ld.line_dedup(clashing(df)).collect()
    assert sorted((str(r["row"]["doc_id"]), str(r["text"]), r["n_lines"], r["n_removed"], str(list(r["removed"]))) for r in got) == sorted(want)
    assert ld.line_dedup(df.limit(0)).count() == 0


def fetched_sets(monkeypatch):
    """Counts of the documents whose sets are fetched, step by step."""
    found, plain = [], nd.checkpointed

    def spy(df):
        out = plain(df)
        if out.columns == nd.MEMBER_NAMES:
            found.append(out.count())
        return out

    monkeypatch.setattr(nd, "checkpointed", spy)
    return found


def test_documents_that_share_boilerplate_ship_no_sets(spark, monkeypatch):
    """All pairs have a similarity of about 0.5: many share a band key, none is linked."""
    fetched = fetched_sets(monkeypatch)
    shared = " ".join(f"same{i}" for i in range(70))
    rows = [(k, shared + " " + " ".join(f"own{k}x{i}" for i in range(33))) for k in range(2000)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8), width=5, percent=80).collect()
    assert all(r.id == r.component_id for r in got) and len(got) == 2000
    assert len(fetched) == 2 and sum(fetched) < 200


def test_large_family_of_near_copies_is_linear(spark, monkeypatch):
    """Every document has one word of its own: one row each with the hub, and few with others."""
    fetched = fetched_sets(monkeypatch)
    words = [f"w{i}" for i in range(150)]
    rows = [(k, " ".join([*words[: k % 150], f"own{k}", *words[k % 150 + 1 :]])) for k in range(3000)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8), width=5, percent=80).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(fetched) < 2 * 3000


def test_chains_of_near_copies_are_found_beside_a_large_component(spark, monkeypatch):
    """Links that no hub sees: documents far from the smallest id but near to others under its keys."""
    monkeypatch.setattr(nd, "CHUNK_DOCS", 8)
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(150):
        own = list(base)
        for i in rnd.sample(range(100), rnd.randint(0, 7)):
            own[i] = f"{i}v{rnd.randrange(3)}"
        rows.append((k, " ".join(own)))
    grams = {k: {tuple(w[i : i + 5]) for i in range(96)} for k, w in ((k, t.split()) for k, t in rows)}
    parent = list(range(150))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(150):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if 100 * both >= 80 * (len(grams[i]) + len(grams[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert len({root(k) for k in range(150)}) > 3
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), width=5, percent=80).collect()
    assert {r.id: r.component_id for r in got} == {k: root(k) for k in range(150)}


def test_line_dedup_repeated_rows_are_one_place(spark):
    rows = [(1, "a b c d e\nx"), (1, "a b c d e\nx"), (2, "a b c d e"), (2, "a b c d e")]
    got = ld.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["row"]["doc_id"], r["text"]) for r in got) == [(1, "a b c d e\nx")] * 2 + [(2, "")] * 2


def test_line_dedup_is_linear_in_a_long_text(spark):
    """100,000 lines, copied once, twice within itself, and a long text of one line."""
    text = "\n".join(f"line number {i} of a long text" for i in range(100_000))
    rows = [(1, text), (2, text), (3, "own\n" + text), (4, "word " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ld.line_dedup(df.where("doc_id = 4")).collect()
    begin = time.perf_counter()
    got = {r["row"]["doc_id"]: r for r in ld.line_dedup(df).collect()}
    assert time.perf_counter() - begin < 60
    assert [got[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 100_000, 100_000, 0] and got[3]["text"] == "own"


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op8_packing(docs.where("doc_id <> 901 and doc_id is not null")).collect()
    by, windows = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in odd_docs():
        if doc in (None, 901):
            continue
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total, padding = total + at, padding + (2048 - at if at & (at - 1) else 0)
    assert padding <= 2048 + 64
    assert op8_packing(docs.limit(0)).count() == 0
    twice = op8_packing(docs.where("doc_id = 901")).collect()
    assert sum(r.length for r in twice) == 8


def test_packed_windows_hold_the_ids(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, windows, own = Tokenizer.from_file(path), {}, {}
    for r in pack(docs.where("doc_id <> 901 and doc_id is not null"), path).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, ids))
        own.setdefault(r.doc_id, []).append((r.start, ids))
    together = {k: [i for _, ids in sorted(pieces) for i in ids] for k, pieces in windows.items()}
    assert max(len(w) for w in together.values()) == 2048
    assert sum(w.count(1) for w in together.values()) == len(own)
    for doc, text in odd_docs():
        if doc not in (None, 901):
            assert [i for _, ids in sorted(own[doc]) for i in ids] == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


#: Characters at the edges of every rule that the encoders split by.
ALPHABET = "abc the'sXYZ09_-\t\n\x00\x1c\x7f\xa0\xb2éÉİıŉſßΣς日本ﬁ🙂́​ 　▁<|endoftext|><s>"


def random_texts(n=3000):
    rnd = random.Random(8)
    return ["", " ", "\n\n", "a<|endoftext|>b"] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_part_encoder_equals_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, texts = Tokenizer.from_file(path), random_texts()
    for text, ids in zip(texts, PartEncoder(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_span_encoder_equals_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), random_texts()
    whole.encode_special_tokens = True
    whole.post_processor = processors.ByteLevel(trim_offsets=False)
    for text, spans in zip(texts, SpanEncoder(path).spans(texts), strict=True):
        assert [tuple(x) for x in spans.tolist()] == whole.encode(text, add_special_tokens=False).offsets, repr(text)


def test_piece_encoder_equals_library(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, encoder, texts = sentencepiece.SentencePieceProcessor(model_file=path), WordEncoder(path), random_texts()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert encoder.decode(ids) == library.decode(want)
    got = {r.doc_id: (r.n_ids, r.decoded_sha256) for r in op3_piece_viterbi(docs).collect()}
    for doc, text in odd_docs():
        ids = library.encode(text or "")
        assert got[doc] == (len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert op3_piece_viterbi(docs.limit(0)).count() == 0


def test_paths_by_score_have_the_largest_sum():
    """Against all segmentations, for made-up pieces whose scores decide."""
    rnd = random.Random(11)
    encoder = WordEncoder(public_tokenizers.path("piece_bpe_32k.model"), by_score=True)
    scores = {p: -rnd.uniform(0.5, 6) for p in {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(40)}}
    scores.pop("c", None)  # a character beyond the vocabulary
    encoder.pieces.score, encoder.pieces.longest, encoder.pieces.least = scores, 4, min(scores.values())

    def worth(parts):
        return sum(scores[p] if p in scores else encoder.pieces.least - 10.0 for p in parts)

    def every(word):
        if not word:
            yield []
        for n in range(1, min(4, len(word)) + 1):
            if word[:n] in scores or n == 1:
                yield from ([word[:n], *rest] for rest in every(word[n:]))

    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(200)}
    for word, last in encoder.paths(list(words)):
        parts, end = [], len(word)
        while end:
            parts.insert(0, last[end])
            end -= len(last[end])
        assert "".join(parts) == word and abs(worth(parts) - max(map(worth, every(word)))) < 1e-9


def test_other_vocabularies_are_refused(spark, docs, tmp_path):
    """Rules that texts aren't split by here raise, before any job."""
    byte_path, word_path = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    with pytest.raises(ValueError, match="normalizer"):
        section_token_counts(docs, word_path)
    with pytest.raises(ValueError, match="normalizer"):
        pack(docs, byte_path)
    other = json.loads(Path(byte_path).read_text())
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="pre_tokenizer"):
        SpanEncoder(str(tmp_path / "other.json"))


def test_packing_is_linear_in_a_long_text():
    def seconds(n):
        packer, ids = Packer(2048, 16, 0), bytes(4 * n)
        begin = time.process_time()
        packer.add(1, 0, ids, n)
        assert sum(r[2] for r in packer.done) + sum(held for held, _ in packer.open) == n
        return time.process_time() - begin

    assert seconds(8_000_000) < 30 * max(seconds(1_000_000), 0.01)


def test_fingerprints_of_edited_texts_reuse_prefix_arrays():
    rnd = random.Random(7)
    for _ in range(300):
        one, two = ("".join(rnd.choice("abé🙂") for _ in range(rnd.choice([0, 1, 5, 15, 16, 17, 40, 90]))) for _ in "ab")
        keep, take = rnd.randint(0, len(one)), rnd.randint(0, len(two))
        a, b, want = fp.PrefixHashes(one), fp.PrefixHashes(two), fp.PrefixHashes(one[:keep] + two[:take])
        got = a.edited(keep, b, take)
        assert got.n == want.n and all((x == y).all() for x, y in zip(got.sums, want.sums, strict=True))
        assert (fp.edited_values(got, keep, a.values(), b.values()) == want.values()).all()


def test_substring_dedup_spreads_rows_without_an_id(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(None, " ".join([str(k), *words])) for k in range(40)] + [(5, " ".join(words)), (None, None), (None, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = op4_substring_dedup(df).collect()
    assert len(got) == len(rows) and sorted(r.n_removed for r in got) == [0, 0, 0] + [30] * 40
    assert [r.n_removed for r in got if r.doc_id == 5] == [30]


@pytest.mark.parametrize("rule", ["largest", "first", "last"])
def test_attribution(rule):
    rnd = random.Random(3)
    for _ in range(200):
        length = rnd.randint(1, 30)
        starts = np.array([0, *sorted(rnd.sample(range(1, length + 1), rnd.randint(0, length // 2)))])
        cuts = sorted({0, length, *(rnd.randint(0, length) for _ in range(rnd.randint(0, 8)))})
        spans = np.array(list(zip(cuts, cuts[1:], strict=False)))
        got, crossing = attribute(spans, starts, length, rule)
        for (a, b), section, crosses in zip(spans.tolist(), got.tolist(), crossing.tolist(), strict=True):
            own = [bisect.bisect_right(starts.tolist(), c) - 1 for c in range(a, b)]
            most = max(set(own), key=lambda k: (own.count(k), -k))
            assert section == {"first": own[0], "last": own[-1], "largest": most}[rule]
            assert crosses == (len(set(own)) > 1)


def test_token_counts(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = section_token_counts(clashing(docs), path).collect()
    whole = Tokenizer.from_file(path)
    total: dict = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    for doc, text in odd_docs():
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        assert total[doc] == n * (2 if doc == 901 else 1)
    assert section_token_counts(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError, match="unknown rule"):
        section_token_counts(docs, path, rule="most")


def test_fingerprints(spark, docs):
    rows = ordered(odd_docs())
    got = sorted(fp.fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for i, ((doc, text), r) in enumerate(zip(rows, got, strict=True)):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        moved = len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        assert (r.doc_id, r.n_chars) == (doc, len(text))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [fp.fingerprint(fp.PrefixHashes(x)) for x in (text, edited, after)]
        assert (r.fingerprint, r.edited_fingerprint) == tuple(prints[:2])
        assert (r.near_edited, r.near_next) == (fp.likeness(*prints[:2]), fp.likeness(prints[0], prints[2]))
        common = next((k for k, (a, b) in enumerate(zip(text, edited, strict=False)) if a != b), min(len(text), len(edited)))
        assert r.common_prefix == common
    one = fp.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.fingerprints(docs.limit(0)).count() == 0


def test_span_hashes_and_extensions():
    rnd = random.Random(6)
    text = "".join(rnd.choice("ab") for _ in range(300))
    hashes = fp.PrefixHashes(text)
    for _ in range(500):
        a, b, n = rnd.randrange(280), rnd.randrange(280), rnd.randrange(20)
        assert (hashes.span(a, a + n) == hashes.span(b, b + n)) == (text[a : a + n] == text[b : b + n])
        k = 0
        while max(a, b) + k < 300 and text[a + k] == text[b + k]:
            k += 1
        assert hashes.common_extension(a, hashes, b) == k


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'>"
    "<header>H</header><nav><ul><li><a href=/x>Menu</a></li></ul></nav><div class='ad'>Buy</div><div id=cookie-notice>Cookies</div>"
    "<article><h1>Title&nbsp;&amp; more</h1><p>One <b>two</b>three<br>four<p>five\n  six<aside>no</aside>"
    "<form><input>sub</form><div class='comments'><article class=comment>said</article></div></article><aside>side</aside><!-- c -->"
    "<footer>&copy; F</footer>"
)


def test_main_text():
    assert main_text(parse(PAGE + "</body></html>")) == "Title & more One twothree four five six"
    assert main_text(parse(PAGE)) == main_text(parse(PAGE[: PAGE.index("<aside>side")]))
    for odd in ("", "plain", "<", "<p", "</p>", "<p><p>a", "<script>x", "<!-- x", "<a href='>x"):
        main_text(parse(odd))
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(parse(deep)) == "x"
    assert main_text(parse("<p>a<p>b</p> c<ul><li>d<li>e</ul>")) == "a b c d e"


def clashing_pages(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("host", "page", "own", "strict", "hash", "a.b"))])


def test_wrappers_of_the_main_text_stay():
    for page in (
        "<div class='layout has-sidebar'><article>Text</article></div>",
        "<section id='content' class='no-sidebar'><p>Text</p></section>",
        "<article><div class='social-science'>Text</div></article>",
        "<article><p class='search-engine'>Text</p></article>",
        "<form id=aspnet><article>Text</article></form>",
        "<aside><article>Text</article></aside>",
        "<main>Text<div class='comment-list'>no</div></main><aside><article>no</article></aside>",
        "<article>Text</article><div class='related'><article>no</article></div>",
        "<div class='site-footer'>no</div><article>Text<div class='ad'>no</div></article>",
    ):
        assert main_text(parse(page)) == "Text", page


@pytest.mark.parametrize("page", ["<b>" * 350_000 + "x", "<b>" * 100_000 + "<h1>x</h1>" * 50_000, "<p><b>" * 150_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" + "<i class=c>" * 5 + "</div>" * 100_000])
def test_parsing_is_linear(page):
    begin = time.process_time()
    main_text(parse(page[: len(page) // 8]))
    small = time.process_time() - begin
    main_text(parse(page))
    assert time.process_time() - begin - small < 8 * 3 * max(small, 0.05)


def test_templates_are_found_by_counting(spark):
    """Menus, adverts and footers go by their skeletons, without any list of tags or names."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like '%blog.tionsh.example.com%'")
    want = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    counted = extract_main_text(pages, lists=False, main_only=False).collect()
    assert len(want) > 100 and {r.page_id: r.text for r in counted} == want
    few = extract_main_text(pages.limit(3), lists=False, main_only=False).collect()
    assert all(len(r.text) > len(want[r.page_id]) for r in few)


def test_templates_on_pages_without_main_elements(spark):
    """Menus of other words each, a fixed notice, and text of one place on all pages, which stays."""
    def page(i):
        menu = "".join(f"<li><a href=/{i}{k}>item {i} {k}</a></li>" for k in range(3 + i % 4))
        return f"<html><body><div class=m><ul>{menu}</ul></div><div class=t><p>Own {i} text</p><p>and more {i * 7}</p></div><p>Same notice</p></body></html>"

    plain = [(i, "http://h.example/x", page(i)) for i in range(200)]
    marked = [(1000 + i, "http://h.example/y", page(i).replace("<div class=t>", "<article>").replace("</p></div>", "</p></article>")) for i in range(6)]
    df = spark.createDataFrame(plain + marked, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert all(got[i] == f"Own {i} text and more {i * 7}" for i in range(200))
    assert all(got[1000 + i] == f"Own {i} text and more {i * 7}" for i in range(6))


def test_site_templates_go(spark):
    page = "<html><body><div><p>Welcome to our site</p></div><div><p>Own text {0} here</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)]
    rows += [(50, None, page.format(50)), (51, "http://other.example/", None), (52, "http://o.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert [got[i] for i in range(12)] == [f"Own text {i} here" for i in range(12)]
    assert got[50] == "Welcome to our site Own text 50 here" and got[51] == got[52] == ""
    assert extract_main_text(clashing_pages(df)).count() == len(rows)
    assert extract_main_text(df.limit(0)).count() == 0


def test_quality_classifier(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    got = op1_quality_classifier(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    odd = spark.createDataFrame(odd_docs(), SCHEMA)
    scored = score_quality(clashing(odd), fit_quality(docs, labels)).collect()
    assert len(scored) == len(odd_docs()) and all(0 <= r.score <= 1 for r in scored)
    none = score_quality(odd, fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert score_quality(odd.limit(0), fit_quality(docs.limit(0), labels)).count() == 0


def test_quality_rules(spark, docs):
    counted = quality_rules(clashing(docs), counted=True, rules=list(RULES))
    want = {}
    for doc, text in odd_docs():
        words = (text or "").encode().split()
        threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, t in enumerate(threes) if threes.count(t) > 1 for k in range(3)} if len(words) < 3000 else None
        want[doc] = (len(words), None if covered is None else len(covered))
    for r in counted.collect():
        n, repeated = want[r["row"]["doc_id"]]
        assert r.n_words == n and (repeated is None or r.n_repeat_words == repeated)
    verdicts = lambda df: sorted((str(r["row"]["doc_id"]), r.kept) for r in df.collect())
    plain = quality_rules(docs, rules=list(RULES))
    assert verdicts(plain) == verdicts(quality_rules(docs, rules=list(reversed(RULES))))
    assert sorted(r.name for r in order_rules(docs)) == sorted(r.name for r in RULES)
    assert quality_rules(docs.limit(0)).count() == 0
    text = "PythonUDF", "ArrowEval", "MapIn"
    assert not any(t in counted._jdf.queryExecution().toString() for t in text)


RULE_TEXTS = [
    "word " * 60, "a b c " * 20, "\n".join("- " + " ".join(f"p{i}{c}" for c in "abcdef") for i in range(12)),
    "\n".join(" ".join(f"p{i}{c}" for c in "abcdef") + "..." for i in range(12)), " ".join(f"w{i} 12{i} %%" for i in range(30)),
    " ".join(f"of the w{i}" for i in range(40)), " ".join(f"UPPER{i}WORD" for i in range(60)), " ".join(f"fine{i}" for i in range(60)),
    "x" * 5000, None, "",
]


def test_one_verdict_for_every_rule_list(spark):
    """With and without counts, for every single rule, every list that lacks one, none at all, and the measured order."""
    docs = spark.createDataFrame(list(enumerate(RULE_TEXTS)), SCHEMA)
    lists = [[], None, *([r] for r in RULES), *([x for x in RULES if x is not r] for r in RULES)]
    for rules in lists:
        one, two = (
            {r["row"]["doc_id"]: r.kept for r in quality_rules(docs, rules=rules, counted=counted).collect()} for counted in (True, False)
        )
        assert one == two and one[7] and not one[0] and not one[1] and not one[9]
    alone = {r.name: {i for i, kept in ((x["row"]["doc_id"], x.kept) for x in quality_rules(docs, rules=[r]).collect()) if not kept} for r in RULES}
    base = {x["row"]["doc_id"] for x in quality_rules(docs, rules=[]).collect() if not x.kept}
    assert alone["bullet_lines"] - base == {2} and alone["ellipsis_lines"] - base == {3}
    assert 4 in alone["letters"] and 5 in alone["top_pair"] and 6 in alone["capitals"]


def test_rules_are_ordered_by_what_others_leave(spark):
    """A rule that rejects only rows which a cheaper one rejects too comes last."""
    docs = spark.createDataFrame([(i, "few" if i % 2 else " ".join(f"w{j}" for j in range(3000))) for i in range(100)], SCHEMA)
    same, wide, never = (Rule(n, u, r) for n, u, r in (("same", ("words", "repeats"), "n_repeat_words >= 0 and n_words < 2"), ("wide", ("words",), "n_words < 3"), ("never", ("words",), "false")))
    order = [r.name for r in order_rules(docs, rules=(never, same, wide))]
    assert order[0] == "wide"
    failed = quality_rules(docs, rules=[wide, same], counted=False).select("failed_rule").distinct().collect()
    assert {r.failed_rule for r in failed} == {"base", None}


def votes_by_hand(texts, sample, labels):
    """Exact cosines and votes, one document after another, in plain Python."""
    model = NeighbourModel.fit(term_counts(sample), np.array(labels, dtype=np.float32))

    def vector(text):
        counts = term_counts([text])[0]
        share = np.sqrt(counts / max(counts.sum(), 1))
        weighted = share * model.idf
        projected = (weighted / max(np.linalg.norm(weighted), 1e-9)) @ model.projection
        return projected / max(np.linalg.norm(projected), 1e-9)

    known = [(vector(t), y) for t, y in zip(sample, labels, strict=True)]
    for text in texts:
        own = vector(text)
        near = sorted(((float(own @ v), y) for v, y in known), key=lambda x: -x[0])[:31]
        weights = [max(c, 0.0) ** 8 for c, _ in near]
        total = sum(weights)
        yield sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / total if total > 0 else sum(labels) / len(labels)


def test_quality_scores_equal_votes_by_hand(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    taught = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 5)
    got = {r.doc_id: r for r in op1_quality_classifier(docs, labels).collect()}
    assert set(got) == set(texts)
    some = sorted(texts)[:200]
    want = votes_by_hand([texts[d] for d in some], [texts[d] for d, _ in taught], [float(y) for _, y in taught])
    for doc, score in zip(some, want, strict=True):
        assert abs(got[doc].score - score) < 2e-3, doc
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        assert got[doc].predicted == (got[doc].score >= 0.3)


def test_repeated_ids_teach_once(spark):
    rows = [(1, "good words here"), (1, "other text"), (2, "bad 123"), (2, "bad 123"), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    models = [fit_quality(spark.createDataFrame(r, SCHEMA).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert len(models[0].labels) == 2 and (models[0].vectors == models[1].vectors).all()
