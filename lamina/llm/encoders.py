"""Exact BPE ids of whole texts, memoised by space-delimited chunk.

Both vocabularies cut a text into pieces before they merge, and no piece reaches over the space in front
of a chunk. The ids of a text are hence those of its chunks in a row, and each chunk is encoded once while
it stays in a bounded two-generation cache. A text with anything that could break this (a special token,
white space other than single blanks and newlines, characters beyond Latin-1) goes to the tokenizers library as a whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Entries in each of a cache's two generations (about 200 bytes an entry).
CACHE_ENTRIES = 150_000


class ChunkCache(dict):
    """chunk -> ids as bytes. When the young generation is full it becomes the old one; hits there return to the young."""

    def __init__(self, encode, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(path: str) -> tuple[dict[int, bytes], dict[int, str]]:
    """id -> bytes of the ordinary tokens, id -> text of the special ones."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = byte_alphabet()
    special = {t["id"]: t["content"] for t in spec["added_tokens"]}
    suffix = spec["model"].get("end_of_word_suffix") or ""
    out = {}
    for token, i in spec["model"]["vocab"].items():
        if i not in special:
            body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
            out[i] = bytes(back[c] for c in body) + (b"\xff" if body is not token and len(body) < len(token) else b"")
    return out, special


#: Letters and digits among the Latin-1 characters, as the pre-tokenizers' Unicode classes have them, and white space.
LETTER, DIGIT, SPACE = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
BYTE_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
#: White space that the fast path doesn't take, for either vocabulary.
ODD_FOR_WORDS = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
ODD_FOR_BYTES = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r", *ODD_FOR_WORDS)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 16-bit integers; for the few ids of a chunk an array is far quicker than numpy."""
    own = array("H", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


class Encoder:
    """Ids of whole texts as little-endian unsigned 16-bit integers (both vocabularies have fewer than 65,536)."""

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        self.path, self.limit = path, limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))
        self.odd_parts = (*self.special, *(ODD_FOR_WORDS if self.by_word else ODD_FOR_BYTES))
        self.first = ChunkCache(lambda c: self.pieces(c), 20_000)
        self.rest = ChunkCache(self.words if self.by_word else self.spaced, limit)
        self._library = None
        self.merge = self._merger()

    def _merger(self):
        """bytes of one piece -> ids. Ranks in order of ids make tiktoken's merge loop follow the vocabulary's own merges."""
        import tiktoken

        ranks = {b: i for i, b in token_bytes(self.path)[0].items()}
        if self.by_word:  # an end of word is one more byte that joins its neighbour first of all
            ranks[b"\xff"] = ranks.pop(b"\xff", len(ranks) + 1000)
        core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe
        return core.encode_single_piece

    def pieces(self, chunk: str) -> bytes:
        merge, ids = self.merge, []
        for piece in BYTE_PIECES.findall(chunk):
            ids += merge(piece.encode())
        return packed(ids)

    def spaced(self, chunk: str) -> bytes:
        """Ids of a chunk behind its space; letters alone are one piece."""
        if chunk.isascii() and chunk.isalpha():
            return packed(self.merge(b" " + chunk.encode()))
        return self.pieces(chunk if chunk[:1] == "\n" else " " + chunk)

    def words(self, chunk: str) -> bytes:
        merge = self.merge
        if chunk.isascii() and chunk.isalpha():
            return packed(merge(chunk.lower().encode() + b"\xff"))
        ids = []
        for piece in WORD_PIECES.findall(chunk.lower()):
            ids += merge(piece.encode() + b"\xff")
        return packed(ids)

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def plain(self, text: str) -> bool:
        """Whether the chunks of ``text`` can be encoded one by one."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(s in text for s in self.odd_parts)

    def odd(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return self.odd(text)
        if self.by_word:
            return b"".join(map(self.rest.__getitem__, text.split()))
        head, *tail = text.replace("\n", " \n").split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all the tasks that a Python worker runs."""
    return Encoder(path)
