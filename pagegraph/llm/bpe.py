"""Byte-level BPE: exact encoding and decoding of whole texts.

``UnitEncoder`` cuts a text at every single blank between two non-blank characters.
The pre-tokenizer of byte-level BPE never matches across such a blank, so each unit
can be encoded alone, and what was encoded once is kept.  The kept units are a cache
with a stated size that is emptied when full; results never depend on it.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

SPECIAL = "<|endoftext|>"
CLEAN_BLANK = re.compile(r"(?<=\S) (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: visible Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load(path: str):
    """(merge engine, id -> bytes, special token -> id) of a tokenizer file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token != SPECIAL}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    engine = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = max([*ranks.values(), *special.values()]) + 1
    pieces = [b""] * size
    for token, i in ranks.items():
        pieces[i] = token
    for token, i in special.items():
        pieces[i] = token.encode()
    return engine._core_bpe, pieces, special


class _Unclean(Exception):
    """A unit begins or ends with white space, so the simple cut at blanks isn't safe."""


class _Units(dict):
    """Unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode, lead: str, most: int):
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, part: str) -> bytes:
        unit = self.lead + part
        if not part and self.lead or part[:1].isspace() and self.lead or part[-1:].isspace():
            raise _Unclean
        out = self.encode(unit)
        if len(part) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[part] = out
        return out


class UnitEncoder:
    """Exact ids of a text; ``encode_unit`` may be replaced by another exact encoder of one unit."""

    def __init__(self, path: str | None = None, encode_unit=None, most: int = 300_000):
        self.core, self.pieces, self.special = load(path or default_path())
        self.encode_unit = encode_unit or self.merge
        self.first = _Units(self.encode_unit, "", most // 10)
        self.rest = _Units(self.encode_unit, " ", most)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def merge(self, unit: str) -> bytes:
        return array("I", self.core.encode_ordinary(unit)).tobytes()

    def _plain(self, text: str) -> bytes:
        head, *tail = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
        except _Unclean:
            return b"".join(map(self.encode_unit, CLEAN_BLANK.sub("\0\0 ", text).split("\0\0"))) if "\0\0" not in text else self.merge(text)

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, packed; special tokens in the text become their own ids."""
        if not text:
            return b""
        if not any(token in text for token in self.special):
            return self._plain(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += [self._plain(text[at : found.start()]) if found.start() > at else b"", self.special[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join(out) + (self._plain(text[at:]) if at < len(text) else b"")

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
