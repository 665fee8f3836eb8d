"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut by the vocabulary's pattern into pieces; within a piece, the lowest-rank adjacent pair is
merged again and again. Its token count is its bytes minus the merges made; no identifier is ever formed.
Special strings inside a text count as one token each, as the tokenizers library does by default.
Null counts as an empty text: 0 bytes, 0 tokens.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import env_path, map_texts

# The public byte-level pattern, and the bytes that its vocabulary files write as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same classes as the pattern has within ASCII: there the standard library's engine is faster.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_chars() -> dict[int, str]:
    """Each byte's character in the vocabulary file; bytes that aren't printed take the code points from 256 on."""
    rest = [b for b in range(256) if b not in set(_PRINTED)]
    return {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Counts for one vocabulary. Pieces met lately are kept: two dictionaries of at most KEEP, the older is dropped when the newer is full."""

    KEEP = 250_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = {c: bytes([b]) for b, c in _byte_chars().items()}
        raw = lambda s: b"".join(chars[c] for c in s)
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[raw(a), raw(b)] = rank
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.cut = regex.compile(PATTERN).findall
        self.cut_ascii = re.compile(ASCII_PATTERN).findall
        self.seen: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one piece. Symbols form a doubly linked list; the heap holds (rank, place) of adjacent pairs."""
        raw = text.encode("utf-8")
        n = len(raw)
        if n < 2:
            return n
        sym = [raw[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not sym[i] or rank((sym[i], sym[j])) != r:  # a pair that an earlier merge has changed
                continue
            sym[i] += sym[j]
            sym[j] = b""
            k = after[i] = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if (s := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (p := before[i]) >= 0 and (s := rank((sym[p], sym[i]))) is not None:
                heapq.heappush(heap, (s, p))
        return n - merges

    def plain(self, text: str) -> int:
        total = 0
        for x in self.cut_ascii(text) if text.isascii() else self.cut(text):
            c = self.seen.get(x)
            total += self.fresh(x) if c is None else c
        return total

    def fresh(self, x: str) -> int:
        c = self.older.get(x)
        if c is None:
            c = self.piece(x)
        if len(x) <= 64:
            if len(self.seen) >= self.KEEP:
                self.older, self.seen = self.seen, {}
            self.seen[x] = c
        return c

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        at = total = 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, text: str = "text") -> DataFrame:
    """docs' columns but text, with n_bytes, n_tokens, over_limit (n_tokens > limit); columns of these names are replaced.

    vocabulary: the path of a byte-level BPE .json that executors can open; by default the public package's
    byte_bpe_50k.json, looked up on each executor. A map over rows, without a shuffle."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    keep = [f for f in docs.schema if f.name != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + "n_bytes long, n_tokens long, over_limit boolean"

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        m = merger(vocabulary or env_path("byte_bpe_50k.json"))
        texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
        n = [m.count(x) for x in texts]
        cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
        made = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
        return pa.RecordBatch.from_arrays([*cols, *made], names=[*(f.name for f in keep), "n_bytes", "n_tokens", "over_limit"])

    return map_texts(docs, fn, schema)
