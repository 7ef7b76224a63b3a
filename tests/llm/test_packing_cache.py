"""The packing encoder's caches: common parts are never encoded again, ids are the library's."""

import random
import struct

import public_tokenizers
import pytest

from glmframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_a_common_part_is_merged_once(monkeypatch):
    """Parts known before the caches start anew are looked up, not encoded again (they were)."""
    monkeypatch.setattr(packing, "CACHE_PARTS", 50)
    monkeypatch.setattr(packing, "CACHE_PIECES", 100)
    encoder, asked = packing.PartEncoder(PATH), []
    tokens = encoder.merges.tokens
    monkeypatch.setattr(encoder.merges, "tokens", lambda piece: asked.append(piece) or tokens(piece))
    for k in range(20):
        encoder.encode(["common word " + " ".join(f"x{chr(97 + k)}{chr(97 + i)}" for i in range(25))])
    assert asked.count("common") == asked.count("word") == 1
    # bounded all the same
    assert max(len(encoder.parts) + len(encoder.old_parts), len(encoder.pieces) + len(encoder.old_pieces)) < 200


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_the_librarys(seed):
    draw = random.Random(seed)
    signs = ["a", "B", "é", "It", "'s", "'", ".", ",", "!", "?", ";", ":", "1", "_", "<", "[", "]", " ", "\n", "ſ", "İ", "²", "ª", "K", "的"]
    texts = ["", *("".join(draw.choices(signs, k=draw.randint(1, 8))) for _ in range(3000))]
    encoder = packing.PartEncoder(PATH)
    want = [e.ids for e in encoder.merges.whole.encode_batch(texts, add_special_tokens=False)]
    got = [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in encoder.encode(texts)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
