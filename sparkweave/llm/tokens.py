"""Token ids from public tokenizer files, with a memory of the pieces that words are.

A text is cut by the tokenizer's own piece pattern; the ids of a piece don't
depend on its neighbours, so each distinct piece is encoded by the tokenizers
library's model once and remembered. Texts with characters for which the pattern here
and the library's might differ go to the library whole.

Where pieces are words without white space, many texts are cut at once, by the kinds
of their bytes, and the memory is asked once for each distinct piece of them.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

#: Pieces after which the memory of a worker begins a new generation; the last one is still asked.
REMEMBERED = 500_000
#: Characters of texts that are cut at once; a longer text is alone. More would ask the memory less often and need more room.
TOGETHER = 1 << 20
#: ASCII without the separators \x1c-\x1f, Latin letters, and common punctuation: here Python's classes and the library's are the same.
_SAFE = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ňŊ-ſ‐-‧‰-›€]")
#: The letters and white space that safe text can have, as plain ranges, which match much faster than character categories.
_LETTERS, _SPACES = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ", r" \t-\r"
_OTHER = f"[^{_SPACES}{_LETTERS}0-9]"
#: By the pattern that a tokenizer file names: how its pieces are found in safe text. Alternatives that begin with different characters are tried by frequency.
_PIECES = {
    "bytes": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?{_OTHER}+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"),
    "words": re.compile(rf"[{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|{_OTHER}+"),
}
#: Kinds of characters in the pattern of words, by code point and, for ASCII, by byte; characters of three bytes or more are others.
_SPACE, _LETTER, _DIGIT, _REST = range(4)
_KINDS = np.array(
    [_SPACE if re.match(f"[{_SPACES}]", c) else _LETTER if re.match(f"[{_LETTERS}]", c) else _DIGIT if re.match("[0-9]", c) else _REST for c in map(chr, range(0x800))], np.uint8
)
_BYTE_KINDS = _KINDS[:0x80].tobytes() + bytes([_REST]) * 0x80
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models use for bytes: printable ones stand for themselves, the others are numbered from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memory(dict):
    """Ids of pieces, by piece; what neither this nor the last generation has is encoded by the library's model."""

    def __init__(self, model):
        self.model, self.letters, self.last = model, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        out = self.last.get(piece)
        if out is None:
            letters = piece if piece.isalpha() and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            out = _bytes([t.id for t in self.model.tokenize(letters)])
        self[piece] = out
        return out

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.last = dict(self)
            self.clear()


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of lower-case texts by the pattern of words, and where those of each text begin."""
    whole = b"\n".join([*texts, b"\n\n"])
    chars = np.frombuffer(whole, np.uint8)
    kinds = np.frombuffer(bytearray(whole.translate(_BYTE_KINDS)), np.uint8)
    two = np.flatnonzero((chars >= 0xC0) & (chars < 0xE0))
    kinds[two] = kinds[two + 1] = _KINDS[(chars[two] & np.uint16(31)) << 6 | chars[two + 1] & 63]
    begins = kinds == _DIGIT
    begins[0] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    quotes = np.flatnonzero(chars == ord("'"))
    quotes = quotes[begins[quotes]]
    first, second = chars[quotes + 1], chars[quotes + 2]
    short = np.isin(first, list(b"stmd"))
    long = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    begins[quotes[short | long] + 1] = False
    after = np.concatenate([quotes[short] + 2, quotes[long] + 3])
    begins[after[kinds[after] == _LETTER]] = True
    starts = np.flatnonzero(begins).astype(np.int32)
    shown = kinds[starts] != _SPACE
    offsets = np.zeros(np.count_nonzero(shown) + 1, np.int32)
    np.cumsum(np.diff(starts, append=np.int32(len(chars)))[shown], out=offsets[1:])
    pieces = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars[kinds != _SPACE])])
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)], dtype=np.int32)
    return pieces, np.searchsorted(starts[shown], firsts)


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes, the same as the library's plain call: a special token's string gets its id."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.memory = _Memory(self.tokenizer.model)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.pieces, self.lower = None, False
        if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            self.pieces = _PIECES["bytes"]
        elif before.get("type") == "Sequence" and (before["pretokenizers"][0].get("pattern") or {}).get("Regex") == _WORD_PATTERN:
            self.pieces, self.lower = _PIECES["words"], True

    def encode(self, text: str) -> bytes:
        """Ids of a text, without any that the tokenizer would add."""
        if self.pieces is None or _SAFE.search(text) or any(s in text for s in self.special):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        self.memory.age()
        return b"".join(map(self.memory.__getitem__, self.pieces.findall(text.lower() if self.lower else text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text."""
        out, group, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not self.lower or _SAFE.search(text) or any(s in text for s in self.special):
                out[i] = self.encode(text)
                continue
            if size + len(text) > TOGETHER and group:
                self._encode_words(texts, group, out)
                group, size = [], 0
            group.append(i)
            size += len(text)
        if group:
            self._encode_words(texts, group, out)
        return out

    def _encode_words(self, texts: list[str], group: list[int], out: list[bytes]) -> None:
        pieces, firsts = _words([texts[i].lower().encode() for i in group])
        if not len(pieces):
            return
        self.memory.age()
        pieces = pieces.dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(list(map(self.memory.__getitem__, names)), pa.large_binary()).take(pieces.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[firsts].tolist()
        data = memoryview(data or b"")
        for i, a, b in zip(group, ends, ends[1:]):
            out[i] = bytes(data[a:b])


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The worker's encoder for a tokenizer file: a name among the public ones, or a path."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
