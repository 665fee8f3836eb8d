"""Benchmark passages inside documents, by pigeonhole edit matching.

Texts and items are normalised (lower case, runs of other than letters and digits become one space). An item of m code
points may differ from a passage by k = floor(m * ERRORS) edits. Cut in k + 1 pieces, at least one piece is in the
passage unchanged: an automaton over the pieces finds exact piece hits, each hit names an item and a place, and Myers'
bit-parallel distance (1999) verifies a window around it. Items shorter than SHORTEST code points take no edits, and count
only between word borders.

The items go to the tasks in blocks of about BLOCK code points (by hash, from the checked total), one after the other: the
driver and a worker hold one block at a time, a larger benchmark makes more of them, and the documents are read once
for each. Every document is compared whole; none leaves its task.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored

ERRORS = 0.08
SHORTEST = 24
BLOCK = 1_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of almost equal length that make up the item."""
    n = budget(item, errors) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def budget(item: str, errors: float = ERRORS) -> int:
    return int(len(item) * errors) if len(item) >= SHORTEST else 0


class Matcher:
    """The automaton over one block of items (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        self.items = items
        self.budget = [budget(t, errors) for _, t in items]
        self.grams: dict[int, set[str]] = {}
        self.masks: dict[int, dict[str, int]] = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for at, piece in pieces(text, errors):
                owners.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.auto.add_word(piece, (len(piece), who))
        if owners:
            self.auto.make_automaton()
        self.any = bool(owners)

    def distance(self, i: int, window: str) -> tuple[int, int]:
        """Least edit distance of item i to any substring of the window, and where that substring ends (Myers 1999)."""
        text = self.items[i][1]
        mask = self.masks.get(i)
        if mask is None:
            mask = self.masks[i] = {}
            for k, c in enumerate(text):
                mask[c] = mask.get(c, 0) | 1 << k
        m = len(text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        for j, c in enumerate(window):
            eq = mask.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    def begin(self, i: int, window: str, d: int, end: int) -> int:
        """Where the passage of distance d that ends at `end` begins: the shortest that has this distance, from the end backwards.

        Row j of the table holds the distances of the item's last j characters to the window's last ones; only the band of d around its diagonal is kept."""
        item, m, far = self.items[i][1], len(self.items[i][1]), d + 1
        back = window[max(0, end - m - d) : end][::-1]
        row = [j if j <= d else far for j in range(m + 1)]  # against nothing of the window
        for n, c in enumerate(back, 1):
            low, high = max(1, n - d), min(m, n + d)
            new = [far] * (m + 1)
            if n <= d:
                new[0] = n
            for j in range(low, high + 1):
                new[j] = min(row[j - 1] + (item[m - j] != c), row[j] + 1, new[j - 1] + 1)
            row = new
            if row[m] <= d:
                return end - n
        return max(0, end - m)

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best passage for each item within its budget; places in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        if not self.any:
            return []
        for last, (n, who) in self.auto.iter(text):
            for i, at in who:
                start = last + 1 - n - at  # where the item would begin
                k, m = self.budget[i], len(self.items[i][1])
                if (i, start) in tried:
                    continue
                done = best.get(i)
                if done and done[0] == 0:
                    continue
                if k == 0 and not (0 <= start <= len(text) - m and text[start - 1 : start] in ("", " ") and text[start + m : start + m + 1] in ("", " ")):
                    continue
                low, high = max(0, start - k), start + m + k
                if high - low < m - k or len(text) - low < m - k:
                    continue
                if text.startswith(self.items[i][1], max(start, 0)):
                    best[i] = 0, max(start, 0), max(start, 0) + m
                    continue
                if k == 0:
                    continue
                tried.add((i, start))
                window = text[low:high]
                grams = self.grams.get(i)
                if grams is None:
                    grams = self.grams[i] = {self.items[i][1][j : j + 3] for j in range(m - 2)}
                if len(grams.difference([window[j : j + 3] for j in range(len(window) - 2)])) > 3 * k:
                    continue
                d, end = self.distance(i, window)
                if d <= k and (not done or d < done[0]):
                    best[i] = d, low + self.begin(i, window, d, end), low + end
        return [(self.items[i][0], *x) for i, x in sorted(best.items())]


@lru_cache(maxsize=1)
def _matcher(items: tuple, errors: float) -> Matcher:
    return Matcher(list(items), errors)


def _blocks(benchmark: DataFrame, most: int):
    """The items in blocks of bounded size, fetched one by one: the query set, never the documents.

    Items that are empty after normalising are left out; of equal item_ids each row is an item of its own."""
    sized = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = sized.agg(F.sum(F.length("text"))).first()[0]
    many = max(1, -(-(chars or 0) // most))
    for b in range(many):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b).distinct().orderBy("item_id", "text").collect()
        items = [(r.item_id, t) for r in rows if (t := normalised(r.text))]
        if items:
            yield items, many > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the best passage of each item in each document that holds it.

    start and end are code points of the normalised text, of the shortest passage of that distance that ends there. A document that appears twice gives its rows twice. A map over
    the documents for each block of items: no shuffle, and the text goes no further; with several blocks, each one's
    rows are stored before the next is fetched. An item that is found in a document only within its budget of edits; null and
    empty texts hold nothing."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(items: list[tuple[int, str]], several: bool) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(tuple(items))

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            m = _matcher(sent.value, errors)
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    rows += [(d, *x) for x in m.search(normalised(t))]
            names = ["doc_id", "item_id", "distance", "start", "end"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

        found = map_texts(docs, fn, "doc_id long, item_id long, distance long, start long, end long")
        if several:
            found = stored(found, "contaminated")
            sent.unpersist()
        return found

    found = [one(*b) for b in _blocks(benchmark, block)]
    if not found:
        return docs.where("false").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("item_id", "distance", "start", "end")])
    return reduce(DataFrame.unionAll, found)


def clean(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """docs without the documents that hold a benchmark passage; all columns stay. A null doc_id is never matched, so its row stays."""
    bad = contaminated(docs, benchmark, errors).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
