"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics come from bytes, words and lines; labels, language, source and identifiers are never inputs. Trees are
fitted on at most SAMPLE labelled rows, those with the smallest hash of doc_id (a documented bound), and flattened
into arrays that numpy walks level by level for a whole batch. Null texts count as empty; they get a score too.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SAMPLE = 20_000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
BINS, TREES, DEPTH, RATE, LEAST_HESSIAN, L2 = 64, 80, 4, 0.15, 2.0, 1.0

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 common punctuation, 7 symbols, 8 beyond ASCII
for _k, _set in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\r\x0b\x0c"), (5, b"\n"), (6, b".,;:'\"?-()"), (7, b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 8
FEATURES = ("log_bytes", "lower", "upper", "digit", "space", "lines", "punct", "symbol", "beyond", "log_words", "word_length", "distinct", "top_word", "runs", "long_words", "symbol_words", "bare_words", "log_lines", "line_length", "repeated_lines", "squeezed", "ends", "top_byte", "numbers")
_ENDS = frozenset(b".!?\"')")
_SYMBOLS = frozenset(b"!#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: bytes) -> list[float]:
    """FEATURES of one text, in time linear in its length (zlib and counting)."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=9) / max(n, 1)
    words = text.split()
    m = len(words)
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    often = Counter(lines)
    lengths = np.fromiter(map(len, seen), np.float64, len(seen))
    times = np.fromiter(seen.values(), np.float64, len(seen))
    total = max(m, 1)
    symbol = sum(c for w, c in seen.items() if w[0] in _SYMBOLS or w[-1] in _SYMBOLS)
    bare = sum(c for w, c in seen.items() if len(w) == 1 and w[0] in _SYMBOLS)
    numbers = sum(c for w, c in seen.items() if w[0] in b"0123456789")
    return [
        np.log1p(n), *share[1:9], np.log1p(m), float(lengths @ times) / total, len(seen) / total,
        max(seen.values(), default=0) / total, sum(map(eq, words, words[1:])) / total,
        float(times[lengths > 20].sum()) / total, symbol / total, bare / total, np.log1p(len(lines)), n / max(len(lines), 1),
        1 - len(often) / max(len(lines), 1), len(zlib.compress(text, 1)) / max(n, 1), float(bool(text) and text.rstrip()[-1:] in {b".", b"!", b"?", b'"', b")"}), float(counts.max(initial=0)) / max(n, 1), numbers / total,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: feature and cut of each inner node, value of each leaf; start is the log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x: all trees step down one level at a time."""
        rows = np.arange(len(x))[:, None]
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(self.value.shape[1]))):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return 1 / (1 + np.exp(-(self.start + self.value[tree, node - self.feature.shape[1]].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms, trees grown level by level."""
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), 0.0)
    if not n:
        return out
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    out.start = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    score = np.full(n, out.start)
    flat = binned + np.arange(width) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            size = many * width * BINS
            hg = np.bincount(at, np.repeat(g, width), size).reshape(many, width, BINS).cumsum(axis=2)
            hh = np.bincount(at, np.repeat(h, width), size).reshape(many, width, BINS).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + L2) + (tg - hg) ** 2 / (th - hh + L2) - tg**2 / (th + L2)
            gain[(hh < LEAST_HESSIAN) | (th - hh < LEAST_HESSIAN)] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    out.feature[t, first + k], out.cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        out.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        score += out.value[t, leaf]
    return out


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _table(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labelled rows outside the held-out fold, at most `sample` of them; null labels don't count, and of
    several labels of one document the least does; of several texts the first in order does, so that repeated rows don't grow the sample."""
    y = labels.where(F.col("quality").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _table(b.column(1).cast(pa.binary()).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = map_texts(rows.select("doc_id", "text", "y"), fn, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, with docs' own columns before them if wanted.

    docs' columns called held_out, score or predicted are replaced. A map over rows; the trees go to the tasks (some KB)."""
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", F.coalesce(fold() == HELD_OUT, F.lit(False)))
    keep = [f for f in docs.schema if keep_columns or f.name in ("doc_id", "held_out")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep) + "score double, predicted int"
    if not keep_columns:
        docs = docs.select("doc_id", "held_out", "text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        p = model.scores(_table(b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()))
        cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
        return pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*(f.name for f in keep), "score", "predicted"])

    return map_texts(docs, fn, schema)
