"""Word-cached encoding with the tokenizers library.

A word BPE file whose splitter drops white space gives a pre-token the same ids wherever it stands.  So
each distinct pre-token goes through the library's model once per worker and texts are joined from the
kept ids; the result equals ``Tokenizer.encode`` of the whole text (tests/llm/test_operators.py).
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Id appended to each document.
END_ID = 1
#: Pre-tokens kept per worker: those seen again, and those seen once; beyond it either starts anew.
CACHE_PIECES, CACHE_FRESH = 200_000, 100_000

#: Texts of these Latin-1 characters alone (ASCII text, accented letters) are split by _MARKS; all others go word
#: by word through the library's own splitter.
_SAFE = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
#: What stands apart from letter runs: contractions, single digits, runs of signs.
_MARKS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    """Ids of lower-case pre-tokens, found by the library's model; one stays when it is asked for again."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.model, self.kind, self.letters = model, kind, _byte_letters()
        self.fresh: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.fresh.pop(piece, None)
        if found is not None:
            self[piece] = found
            return found
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        if len(self.fresh) >= CACHE_FRESH:
            self.fresh.clear()
        self.fresh[piece] = found = array(self.kind, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return found


class WordEncoder:
    """ids of whole texts as little-endian unsigned 16-bit (or 32-bit) buffers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        split = spec.get("pre_tokenizer") or {}
        parts = [p.get("type") for p in split.get("pretokenizers", [])]
        lower = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if parts != ["Split", "ByteLevel"] or lower != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("expected a lower-casing word BPE file whose splitter drops white space")
        self.dtype = np.dtype("<u2") if self.full.get_vocab_size() < 1 << 16 else np.dtype("<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = _Pieces(self.full.model, self.kind)
        self.words: dict[str, bytes] = {}
        self.end = np.array([END_ID], self.dtype).tobytes()

    def _simple(self, text: str) -> bool:
        try:
            return not text.encode("latin-1").translate(None, _SAFE) and not any(s in text for s in self.special)
        except UnicodeEncodeError:
            return False

    def _split_simple(self, text: str) -> list[str]:
        return _MARKS.sub(r" \g<0> ", text.lower()).split()

    def _word(self, word: str) -> bytes:
        """Ids of a word of any characters."""
        if any(s in word for s in self.special):
            return array(self.kind, self.full.encode(word, add_special_tokens=False).ids).tobytes()
        spelled = self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(word))
        return b"".join([array(self.kind, [t.id for t in self.full.model.tokenize(p)]).tobytes() for p, _ in spelled])

    def encode_one(self, text: str) -> bytes:
        """Ids of a text, the end id included."""
        if self._simple(text):
            return b"".join(map(self.pieces.__getitem__, self._split_simple(text))) + self.end
        out = []
        for raw in text.encode("utf-8", "replace").split():
            word = raw.decode()
            if word not in self.words:
                if self._simple(word):
                    self.words[word] = b"".join(map(self.pieces.__getitem__, self._split_simple(word)))
                else:
                    self.words[word] = self._word(word)
            out.append(self.words[word])
        return b"".join(out) + self.end

    def encode(self, texts: list[str]) -> list[bytes]:
        """One buffer of ids per text, the end id included."""
        for kept in (self.pieces, self.words):
            if len(kept) > CACHE_PIECES:
                kept.clear()
        return [self.encode_one(t) for t in texts]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder of a tokenizer file."""
    claim("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
