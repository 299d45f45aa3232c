"""Operator 5: exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one token can be the last of its encoding. A token that ends there is the one if it
starts the piece, or if it may stand next to the last token of the prefix before it. Two tokens may stand next to each other
if undoing their merges, latest first, never meets a pair that would have merged earlier. An automaton over all tokens
lists those that are suffixes of each prefix; back-pointers then give the ids. The published method takes time linear in the piece.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lamina.llm import common
from lamina.llm.encoders import BYTE_PIECES, CACHE_ENTRIES, ChunkCache, Encoder, byte_alphabet, token_bytes

#: The pre-tokenizer's pattern for texts beyond Latin-1 (fixed value of the vocabulary file's ByteLevel step).
ANY_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs whose verdict is kept (about 150 bytes each).
PAIR_ENTRIES = 200_000


class PrefixEncoder(Encoder):
    """Encoder whose pieces are merged by the dynamic program; texts off the fast path are cut by ``regex`` and take it too."""

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        import regex

        super().__init__(path, limit)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.bytes_of, self.special_of = token_bytes(path)
        self.id_of_special = {text: i for i, text in self.special_of.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.id_of_special, key=len, reverse=True))) + ")") if self.id_of_special else None
        self.any_pieces = regex.compile(ANY_PIECES)
        self.merged, self.halves = {}, {}
        merges = spec["model"]["merges"]
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merged[i, j] = k
            self.halves.setdefault(k, (i, j))
        if any(i >= k or j >= k for k, (i, j) in self.halves.items()) or len(self.halves) != len(merges):
            raise ValueError("ids must rise in the order of the merges")
        self.verdicts: dict[tuple[int, int], bool] = {}
        self.single = {chr(b): vocab[c] for c, b in back.items()}
        self.automaton = self._automaton()

    def _merger(self):
        return self.encode_piece

    def _automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            found.add_word(b.decode("latin-1"), (i, len(b)))
        found.make_automaton()
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is how BPE leaves their bytes."""
        verdict = self.verdicts.get((left, right))
        if verdict is None:
            if len(self.verdicts) >= PAIR_ENTRIES:
                self.verdicts.clear()
            verdict = self.verdicts[left, right] = self._compatible(left, right)
        return verdict

    def _compatible(self, left: int, right: int) -> bool:
        """Undoes the later of the two tokens' merges again and again. ``until``: merges from this id on came after what is still whole.

        A pair at the border that merges to an id below ``until`` would have done so before the merge undone last.
        """
        until, halves, merged = 1 << 62, self.halves, self.merged
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < until:
                return False
            # the token made last is undone first; of two equal ones the left is made first
            if left in halves and (left > right or right not in halves):
                until, left = left, halves[left][1]
            elif right in halves:
                until, right = right + 1, halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        n = len(text)
        if n == 1:
            return [self.single[text]]
        last = [None] * (n + 1)
        sizes = [0] * (n + 1)
        may_follow = self.may_follow
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - size
                if start == 0 or (last[start] is not None and may_follow(last[start], token)):
                    last[end], sizes[end] = token, size
        ids = []
        while n:
            ids.append(last[n])
            n -= sizes[n]
        return ids[::-1]

    def odd(self, text: str) -> bytes:
        ids = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.id_of_special:
                ids.append(self.id_of_special[part])
            else:
                for piece in self.any_pieces.findall(part):
                    ids += self.encode_piece(piece.encode())
        return np.array(ids, dtype="<u2").tobytes()

    def decode(self, ids) -> str:
        """Text of ids, special tokens kept; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")

    @property
    def table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            found = self.bytes_of | {i: t.encode() for i, t in self.special_of.items()}
            self._table = [found.get(i, b"") for i in range(max(found) + 1)]
        return self._table


@lru_cache(maxsize=1)
def shared_prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, for every row as it comes.

    Null texts count as empty (no ids). Repeated rows and equal or null doc_ids stay rows of their own; an empty table gives no rows; other columns play
    no part, whatever their names. Nothing is shuffled; a row is the unit of work, so memory follows the longest text (some 30 bytes a byte), and the caches are bounded.
    """

    def run(batches):
        encoder = shared_prefix_encoder(tokenizer)
        for pdf in batches:
            rows = []
            for text in pdf.text:
                ids = np.frombuffer(encoder.encode(text), "<u2")
                decoded = encoder.decode(ids.tolist()).encode("utf-8", "surrogatepass")
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == (text or "").encode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
            out.insert(0, "doc_id", pdf.doc_id.to_numpy())
            yield out.astype({"n_tokens": "int64", "round_trip": bool})

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return common.id_long(common.text_batches(docs).select(common.id_text(), "text").mapInPandas(run, schema))


__all__ = ["BYTE_PIECES", "ChunkCache", "PrefixEncoder", "encode_and_decode", "shared_prefix_encoder"]
