"""Byte-level merge vocabularies, applied to the distinct words of a text.

The tokenizers library spends most of its time on normalising and splitting
whole texts. Words of plain Latin text are split here, by the vocabularies'
own patterns put for that alphabet, and only their distinct pieces go through
the library's merges. Anything else goes through the whole library.
"""

from __future__ import annotations

import json
import re

#: Parts of these characters alone are split here: ASCII without odd controls, and Latin letters that neither
#: compose nor change their length in lower case (fixed value).
_PLAIN = "[\t-\r -~À-ÖØ-öø-įı-ɏ]"
#: Pieces a worker remembers at most; beyond it starts anew.
CACHE_PIECES = 300_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in prints:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if not out[b]):
        out[b] = chr(0x100 + k)
    return out


#: Rules of a plain byte-level vocabulary (fixed values).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def check_rules(path: str, normalizer: dict | None, pre_tokenizer: dict | None) -> None:
    """Raises unless a tokenizers file normalises and splits texts by the given rules."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    for name, want in (("normalizer", normalizer), ("pre_tokenizer", pre_tokenizer)):
        if parts[name] != want:
            raise ValueError(f"{path}: its {name} is {parts[name]}, texts are split here for {want}")


class Merges:
    """The merges of a tokenizers file, by piece, for texts that are split by the given rules."""

    def __init__(self, path: str, normalizer: dict | None = None, pre_tokenizer: dict | None = BYTE_LEVEL):
        from tokenizers import Tokenizer

        check_rules(path, normalizer, pre_tokenizer)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        #: Plain characters but those that begin a token which the library looks for before it splits.
        firsts = "".join({x["content"][0] for x in parts["added_tokens"]})
        self.plain = re.compile(f"(?:(?![{re.escape(firsts)}]){_PLAIN})*+" if firsts else f"{_PLAIN}*+").fullmatch
        bare = parts | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.model = self.bare.model
        self.alphabet = byte_alphabet()

    def tokens(self, piece: str) -> list:
        """The library's tokens (id, and value in the byte alphabet) of one piece."""
        themselves = piece.isascii() and piece.isprintable() and " " not in piece
        return self.model.tokenize(piece if themselves else "".join([self.alphabet[b] for b in piece.encode()]))
