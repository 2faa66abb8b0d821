"""Exact byte-level BPE by per-prefix dynamic programming.

Of all ways to cut a piece of text into tokens, BPE's is the only one in which every two neighbouring tokens are
*compatible*: merging the bytes of the two by the rules gives the two back. So the last token of the encoding of every
prefix is unique: it is the one token that ends there, and that is compatible with the last token of the prefix before
it. Prefixes are done from left to right; the candidates are the vocabulary's tokens that are suffixes of the prefix,
found by an Aho-Corasick automaton's suffix links; back-pointers then give the ids. Pieces are the ones the
pre-tokeniser makes; equal pieces are encoded once per worker and kept in a bounded table.

Nulls count as empty texts, which have no ids. The vocabulary file is a parameter and stays outside the repository.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, map_arrow

#: Pieces whose ids a worker keeps; the table starts anew when it is full, so memory is bounded.
KEPT_PIECES = 500_000
#: Longer pieces aren't kept.
KEPT_LENGTH = 64

#: The split of byte-level pre-tokenisers of this family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable, else one from 256 upwards."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Automaton:
    """Tokens as a trie with suffix links: state after reading text -> the longest token that ends there."""

    def __init__(self, tokens: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        for word, number in tokens.items():
            state = 0
            for b in word:
                to = self.next[state].get(b)
                if to is None:
                    to = len(self.next)
                    self.next[state][b] = to
                    self.next.append({})
                    self.token.append(-1)
                state = to
            self.token[state] = number
        self.link = [0] * len(self.next)
        #: The longest token that ends at a state, and for a token's state the next shorter one, through links.
        self.longest = list(self.token)
        self.shorter = [-1] * len(self.next)
        queue = list(self.next[0].values())
        for state in queue:
            link = self.link[state]
            self.shorter[state] = self.longest[link]
            if self.longest[state] < 0:
                self.longest[state] = self.longest[link]
            for b, to in self.next[state].items():
                at = link
                while at and b not in self.next[at]:
                    at = self.link[at]
                self.link[to] = self.next[at].get(b, 0)
                queue.append(to)
        state_of = {n: s for s, n in enumerate(self.token) if n >= 0}
        self.next_shorter = {n: self.shorter[s] for n, s in state_of.items()}


class _Pieces(dict):
    """Piece -> its ids as bytes; missing ones are encoded, and short ones kept."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.piece(piece.encode())
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        symbols = {c: b for b, c in enumerate(byte_symbols())}
        to_bytes = lambda word: bytes(symbols[c] for c in word)
        self.vocabulary = {to_bytes(w): i for w, i in model["vocab"].items() if all(c in symbols for c in w)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: w for w, i in self.vocabulary.items()} | {i: w.encode() for w, i in self.added.items()}
        #: (left, right) -> (rank, joined token), and for each token the pair that makes it.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (to_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            a, b, c = self.vocabulary[left], self.vocabulary[right], self.vocabulary[left + right]
            self.merges[a, b] = (rank, c)
            if c not in self.parts:
                self.parts[c] = (a, b)
                self.rank[c] = rank
        reachable = {w: i for w, i in self.vocabulary.items() if i in self.parts or len(w) == 1}
        self.automaton = Automaton(reachable)
        self.length = {i: len(w) for w, i in reachable.items()}
        self.compatible = lru_cache(1 << 17)(self._compatible)
        self.kept = _Pieces(self)

        import regex

        self.split = regex.compile(PATTERN).findall
        if self.added:
            words = sorted(self.added, key=len, reverse=True)
            self.cut = regex.compile("(" + "|".join(map(regex.escape, words)) + ")").split

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of two neighbouring tokens are merged to just these two.

        The two tokens' own merges are undone from the last; at each cut the pair that touches across the border must
        not be one that would have been merged before the merges still to come inside the tokens.
        """
        limit = 1 << 60
        while True:
            crossing = self.merges.get((left, right))
            if crossing is not None and crossing[0] < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # the left token was finished later: before that, its right part touched the border
                limit = a
                left = self.parts[left][1]
            else:  # of equal ranks the leftmost merges first, so the border's goes before the right token's own
                limit = b + 1
                right = self.parts[right][0]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-tokenised piece."""
        whole = self.vocabulary.get(data)
        if whole is not None and len(data) == 1:
            return [whole]
        auto, length, compatible = self.automaton, self.length, self.compatible
        follow, link, longest, shorter = auto.next, auto.link, auto.longest, auto.next_shorter
        last = [-1]
        state = 0
        for i, b in enumerate(data, 1):
            to = follow[state].get(b)
            while to is None and state:
                state = link[state]
                to = follow[state].get(b)
            state = to or 0
            token = longest[state]
            while token >= 0:
                start = i - length[token]
                if not start or last[start] >= 0 and compatible(last[start], token):
                    break
                token = shorter[token]
            last.append(token)
        ids, i = [], len(data)
        while i:
            ids.append(last[i])
            i -= length[last[i]]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not self.added or not any(word in text for word in self.added):
            return b"".join(map(self.kept.__getitem__, self.split(text)))
        parts = (pack("<I", self.added[p]) if p in self.added else b"".join(map(self.kept.__getitem__, self.split(p))) for p in self.cut(text))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with ``ids array<int>`` if asked for, for every row."""
    arrow_limits(docs.sparkSession)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        counts, hashes, decoded, kept = [], [], [], []
        for text in batch.column(1):
            ids = e.encode(text.as_py() or "")
            counts.append(len(ids) // 4)
            hashes.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            if with_ids:
                kept.append(np.frombuffer(ids, "<i4").tolist())
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            arrays.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(rows, fn, schema)
