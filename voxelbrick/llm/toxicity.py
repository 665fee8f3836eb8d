"""Toxic spans by a linear-chain conditional random field over the words of whole texts.

States are O and T. A word's features are itself, its prefixes and its suffixes, in lower case; labels, language, source
and identifiers are never inputs. Documents are labelled, words are not: a word of a toxic document counts as toxic if
one of its features is met in many separate toxic documents and hardly ever in clean ones (distant labels). The field
is fitted by gradient ascent on at most SAMPLE toxic and SAMPLE clean documents, whole texts of any length (a documented bound
on their number; near copies count as one document). Forward-backward marginals run as a blocked scan of 2x2 products
over all words of a batch; a document's score is the largest marginal of T, its spans are the runs of words at or
above one half. Null, empty and wordless texts score 0 and have no spans.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix, shingle_hashes

SAMPLE = 1000
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
ROUNDS, RATE, L2 = 40, 0.4, 1e-3
PREFIXES, SUFFIXES = range(2, 9), range(2, 6)
#: A feature marks words as toxic if at least LEAST separate toxic documents and SHARE of them have it, and at most RATIO times that share of clean ones.
LEAST, SHARE, RATIO = 4, 0.01, 0.02
_ROW = 64
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    n = len(word)
    return [f"={word}", *(f"^{word[:i]}" for i in PREFIXES if i <= n), *(f"{word[-i:]}$" for i in SUFFIXES if i <= n)]


def _scan(m: np.ndarray) -> np.ndarray:
    """For 2x2 matrices m (n, 4), row by row: v_t proportional to (1, 1) m_0 ... m_t. Rows of _ROW products side by side, then their carries."""
    n = len(m)
    rows = -(-n // _ROW)
    full = np.empty((rows * _ROW, 4))
    full[:n], full[n:] = m, (1, 0, 0, 1)
    p = np.ascontiguousarray(full.reshape(rows, _ROW, 4).transpose(1, 2, 0))  # step, entry, row
    for i in range(1, _ROW):
        (a, b, c, d), (x, y, z, w) = p[i - 1], p[i]
        p[i] = a * x + b * z, a * y + b * w, c * x + d * z, c * y + d * w
        if i % 8 == 7:
            p[i] /= p[i].sum(axis=0)
    carry = np.empty((rows, 2))
    a = b = 0.5
    for r, (x, y, z, w) in enumerate(p[-1].T.tolist()):
        carry[r] = a, b
        a, b = a * x + b * z, a * y + b * w
        s = a + b
        a, b = a / s, b / s
    ca, cb = carry.T
    v = np.stack([ca * p[:, 0] + cb * p[:, 2], ca * p[:, 1] + cb * p[:, 3]], axis=2)  # step, row, state
    v = v.transpose(1, 0, 2).reshape(-1, 2)[:n]
    return v / v.sum(axis=1, keepdims=True)


@dataclass
class Field:
    weights: dict[str, float]
    trans: np.ndarray  # log weights [from, to]
    start: np.ndarray

    def __post_init__(self):
        self.young, self.old = {}, {}

    def emission(self, word: str) -> float:
        """What T gains over O for a word; words met lately are kept, within a bound."""
        s = self.old.get(word)
        if s is None:
            get = self.weights.get
            s = get("", 0.0) + sum(get(f, 0.0) for f in features(word.lower()))
        if len(self.young) >= 200_000:
            self.old, self.young = self.young, {}
        self.young[word] = s
        return s

    def matrices(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(n, 4) potentials into each word, from O then from T; into a text's first word both are its start, which forgets the text before."""
        e = np.exp(np.clip(s, -30, 30))
        (oo, ot), (to, tt) = np.exp(self.trans)
        so, st = np.exp(self.start)
        return np.stack([np.where(first, so, oo), np.where(first, st, ot) * e, np.where(first, so, to), np.where(first, st, tt) * e], axis=1)

    def marginals(self, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """P(T) of each word, and forward, backward and potentials for the gradient."""
        m = self.matrices(s, first)
        forward = _scan(m)
        # backward: b_t = m_{t+1} b_{t+1}, a scan of the transposed potentials from the end
        backward = _scan(np.concatenate([np.ones((1, 4)), m[:0:-1, [0, 2, 1, 3]]]))[::-1]
        p = forward * backward
        return p[:, 1] / p.sum(axis=1), forward, backward, m


def _groups(texts: list[str]) -> list[int]:
    """A group number for each text: texts that share the least hash of their 4-word shingles, by either of two orders, go together."""
    parent = list(range(len(texts)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict = {}
    for i, t in enumerate(texts):
        h = shingle_hashes(t.encode(), 4)
        for k, x in enumerate((h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))) if len(h) else ():
            parent[find(i)] = find(seen.setdefault((k, int(x.min())), i))
    return [find(i) for i in range(len(texts))]


def toxic_features(toxic: list[list[str]], group: list[int], clean: list[list[str]]) -> set[str]:
    """Features that mark words: frequent in toxic groups, rare in clean documents."""
    many, few = defaultdict(set), Counter()
    for words, g in zip(toxic, group, strict=True):
        for w in set(words):
            for f in features(w):
                many[f].add(g)
    for words in clean:
        few.update({f for w in set(words) for f in features(w)})
    nt, nc = len(set(group)), len(clean)
    return {f for f, g in many.items() if len(f) > 3 and f[-1] != "$" and len(g) >= max(LEAST, SHARE * nt) and (few[f] + 0.5) / (nc + 1) <= RATIO * len(g) / nt}


def fit(toxic: list[str], clean: list[str]) -> Field:
    """A field from texts of toxic and of clean documents; without one of either, one that finds nothing."""
    out = Field({"": -8.0}, np.array([[0.0, -2.0], [0.0, 0.0]]), np.array([0.0, -2.0]))
    if not toxic or not clean:
        return out
    words = [[w.lower() for w in _WORD.findall(t)] for t in (*toxic, *clean)]
    marks = toxic_features(words[: len(toxic)], _groups(toxic), words[len(toxic) :])
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for d in words for w in d], np.int64)
    if not len(flat):
        return out
    lengths = np.array([len(d) for d in words])
    first = np.zeros(len(flat), bool)
    first[np.cumsum(lengths[lengths > 0])[:-1]] = True
    first[0] = True
    names: dict[str, int] = {"": 0}
    owner, which = [], []
    marked = np.zeros(len(ids), bool)
    for w, i in ids.items():
        fs = features(w)
        marked[i] = any(f in marks for f in fs)
        which += [0, *(names.setdefault(f, len(names)) for f in fs)]
        owner += [i] * (len(fs) + 1)
    owner, which = np.array(owner), np.array(which)
    in_toxic = np.repeat(np.arange(len(words)) < len(toxic), lengths)
    y = (marked[flat] & in_toxic).astype(np.float64)
    theta, square = np.zeros(len(names)), np.full(len(names), 1e-8)
    theta[0] = -4.0
    tsq, ssq = np.full((2, 2), 1e-8), np.full(2, 1e-8)
    inner = np.flatnonzero(~first)
    yi = y.astype(np.int64)
    pairs = np.bincount(yi[inner - 1] * 2 + yi[inner], minlength=4).reshape(2, 2)
    starts = np.bincount(yi[first], minlength=2)
    scale = 1 / max(y.sum(), 1)
    for _ in range(ROUNDS):
        s = np.bincount(owner, theta[which], len(ids))[flat]
        p, forward, backward, m = out.marginals(s, first)
        xi = forward[inner - 1][:, :, None] * m[inner].reshape(-1, 2, 2) * backward[inner][:, None, :]
        xi /= xi.sum(axis=(1, 2), keepdims=True)
        g = np.bincount(which, np.bincount(flat, y - p, len(ids))[owner], len(names)) * scale - L2 * theta * (np.arange(len(names)) > 0)
        square += g * g
        theta += RATE * g / np.sqrt(square)
        for value, total, grad in ((out.trans, tsq, (pairs - xi.sum(axis=0)) * scale), (out.start, ssq, (starts - np.array([(1 - p[first]).sum(), p[first].sum()])) * scale)):
            total += grad * grad
            value += RATE * grad / np.sqrt(total)
    out.weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 0.02}
    return out


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from labelled rows outside the held-out fold: `sample` toxic and `sample` clean ones, by hash of doc_id.

    Null labels don't count; of several labels of one document the greatest does, of several texts the first in order."""
    y = labels.where(F.col("toxic").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    some = docs.where("text is not null").select("doc_id", "text")
    pick = lambda v: y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = some.join(F.broadcast(pick(1).unionAll(pick(0))), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = rows.toPandas().sort_values(["doc_id", "text"])
    return fit(got["text"][got["y"] == 1].tolist(), got["text"][got["y"] == 0].tolist())


def marked(texts: list[str | None], model: Field) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores and spans (start, end in code points, greatest marginal) of texts."""
    words = [_WORD.findall(t) if t else [] for t in texts]
    lengths = np.array([len(d) for d in words])
    scores, spans = np.zeros(len(texts)), [[] for _ in texts]
    if not lengths.sum():
        return scores, spans
    got: list[float] = []
    for d in words:
        row = list(map(model.young.get, d))
        got += row if None not in row else [model.emission(w) if e is None else e for w, e in zip(d, row, strict=True)]
    s = np.array(got)
    ends = np.cumsum(lengths)
    first = np.zeros(len(s), bool)
    first[(ends - lengths)[lengths > 0]] = True
    p = model.marginals(s, first)[0]
    scores[lengths > 0] = np.maximum.reduceat(p, (ends - lengths)[lengths > 0])
    for i in np.flatnonzero(scores >= 0.5):
        q = p[ends[i] - lengths[i] : ends[i]]
        last = -2
        for k, m in enumerate(_WORD.finditer(texts[i])):
            if q[k] >= 0.5:
                if last == k - 1:
                    start, _, best = spans[i].pop()
                    spans[i].append((start, m.end(), max(best, float(q[k]))))
                else:
                    spans[i].append((m.start(), m.end(), float(q[k])))
                last = k
    return scores, spans


def tag(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_spans for each row of docs (doc_id, text); other columns are dropped. A map over rows."""
    docs = docs.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        p, spans = marked(b.column(2).to_pylist(), model)
        rows = [[{"start": a, "end": e, "score": x} for a, e, x in sp] for sp in spans]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(rows, kind)], names=["doc_id", "held_out", "score", "predicted", "toxic_spans"])

    return map_texts(docs, fn, "doc_id long, held_out boolean, score double, predicted int, toxic_spans array<struct<start:int,end:int,score:double>>")
