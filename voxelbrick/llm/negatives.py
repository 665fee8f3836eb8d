"""Hard negatives by threshold joins in the manner of L2AP (Anastasiu and Karypis 2014): a stated set of anchors against all vectors.

Components become integers, scores are integer inner products, so results are exact. Vectors are packed in blocks; the
anchors, a stated query set, go to the blocks of vectors in blocks of their own. In a block, with a score of at least t asked of an anchor:

* Dimensions are ordered by their energy in the block. A vector's index omits its last dimensions as long as the norm of
  what is omitted times the norm of the anchors there stays below the lowest t: by Cauchy and Schwarz they alone can't reach it.
* Partial scores are accumulated over the indexed dimensions a few at a time; where partial score plus the product of the
  remaining norms is below t, the pair is dropped, and vectors or anchors without pairs leave the computation.
* What remains is scored exactly.

Thresholds start high and are lowered until the windows are full. A bounded sample of the vectors gives each anchor three: one that
its best sampled scores suggest, then one that the sample guarantees (enough of the sampled rows reach it), then the floor below
which nothing is asked (score 0, or the window's lower end). Only anchors whose windows aren't full go on to the next. The first
search is for positives, by label; the second for negatives, in the windows that the positives set. From each block only an anchor's
first few go on, so a vector that is there a million times makes no more rows than a few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
SAMPLE = 2048
BLOCK = 4096
QUERIES = 512
STEP = 16
#: Scores are exact while squared norms stay below this: 64-bit integers hold them, and up to 2**53 doubles do.
MOST_SQUARE = 1 << 62


def quantised(embeddings: DataFrame, scale: int = SCALE, relabel: Column | None = None) -> DataFrame:
    """(vec_id, label, dim, q array<long>): rows that take part, each component x as floor(scale * x).

    Left out: null vec_id, label or vector, null or non-finite components, and vectors whose squared norm reaches 2**62 (their scores aren't
    64-bit integers). Of rows with one vec_id the first by label and vector counts. Vectors only meet others of their length."""
    label = F.col("label").cast("long") if relabel is None else relabel
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**31 / scale)
    rows = rows.where(~F.exists("e", bad)).select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("q"))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where(square < float(MOST_SQUARE)).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    return rows.select("vec_id", "r.label", F.size("r.q").alias("dim"), "r.q")


PACKED = "ids binary, labels binary, matrix binary, asked binary"


def packed(rows: DataFrame, key: list[str], most: int, asked: bool = False) -> DataFrame:
    """rows packed in blocks of about `most`, by key and a hash of vec_id: key, block, ids, labels, matrix (int32), asked (double, 4 a row: see search).

    The blocks of a key follow from its number of rows, so a hot key makes more blocks, never larger ones."""
    many = rows.groupBy(*key).agg(F.ceil(F.count("*") / most).alias("many"))
    dealt = rows.join(many, key).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("many"))).drop("many")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        out = {k: [g[k].iloc[0]] for k in (*key, "block")}
        out |= {"ids": [g["vec_id"].to_numpy(np.int64).tobytes()], "labels": [g["label"].to_numpy(np.int64).tobytes()], "matrix": [np.array(g["q"].tolist(), np.int32).tobytes()]}
        out["asked"] = [np.array(g["asked"].tolist(), np.float64).tobytes() if asked else b""]
        return pd.DataFrame(out)

    return dealt.groupBy(*key, "block").applyInPandas(pack, ", ".join(f"{k} {kinds[k]}" for k in key) + f", block long, {PACKED}")


def survivors(a: np.ndarray, y: np.ndarray, least: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of rows of a and y with a[i] . y[j] >= least[i] (integers; scores exact)."""
    dims = y.shape[1]
    none = np.zeros(0, np.int64)
    if not len(a) or not len(y) or not dims:
        hit = np.nonzero(np.broadcast_to(least[:, None] <= 0, (len(a), len(y)))) if not dims else (none, none)
        return *hit, np.zeros(len(hit[0]), np.int64)
    order = np.argsort(-(y.astype(float) ** 2).sum(axis=0), kind="stable")
    fa, fy = a[:, order].astype(float), y[:, order].astype(float)
    # Norms of what follows position p.
    rest = lambda v: np.sqrt(np.concatenate([np.cumsum((v**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(v), 1))], axis=1))
    ra, ry = rest(fa), rest(fy)
    slack = 1e-9 * (ra[:, 0].max() * ry[:, 0].max()) + 1e-6  # of rounding
    # The index: row j has its first indexed[j] dimensions; what it omits can't reach the lowest threshold alone.
    lowest = float(least.min())
    indexed = (ry * ra.max(axis=0)[None, :] + slack >= lowest).sum(axis=1) if lowest > 0 else np.full(len(y), dims)
    rows, cols = np.arange(len(a)), np.flatnonzero(indexed > 0)
    score = np.zeros((len(rows), len(cols)))
    for p in range(0, dims, step):
        q = min(p + step, dims)
        posted = np.flatnonzero(indexed[cols] > p)  # a row past its index gets nothing more
        if not len(posted):
            break
        part = fa[rows, p:q] @ fy[cols[posted], p:q].T
        if len(posted) == len(cols):
            score += part
        else:
            score[:, posted] += part
        done = np.where(indexed[cols] > p, q, np.minimum(q, -(-indexed[cols] // step) * step))
        bound = score + ra[rows][:, done] * ry[cols, done][None, :] + slack
        alive = bound >= least[rows][:, None]
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not r.any():
            return none, none, none
        if r.sum() < 0.7 * len(r) or c.sum() < 0.7 * len(c):
            rows, cols, score, alive = rows[r], cols[c], score[np.ix_(r, c)], alive[np.ix_(r, c)]
        if alive.sum() < 0.02 * alive.size:
            break
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    exact = np.zeros(len(i), np.int64)
    for k in range(0, len(i), 100_000):
        exact[k : k + 100_000] = np.einsum("ij,ij->i", a[i[k : k + 100_000]], y[j[k : k + 100_000]])
    ok = exact >= least[i]
    return i[ok], j[ok], exact[ok]


def first(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each i by falling score, then rising id."""
    o = np.lexsort((ids[j], -score, i))
    begin = np.concatenate([[True], i[o][1:] != i[o][:-1]]) if len(o) else np.zeros(0, bool)
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(begin, np.arange(len(o)), 0))
    return o[rank < most]


FOUND = "anchor_id long, low double, high double, id long, score long"


def search(asked: DataFrame, blocks: DataFrame, same: bool, most: int, shards: int) -> DataFrame:
    """(anchor_id, low, high, id, score): of each asked row, the first `most` vectors of each block with ask <= score <= high.

    asked: vec_id, label, dim, q, asked (low, high, ask, 0): the window's ends name the window. same: vectors of the anchor's
    label, itself left out; else those of other labels. blocks: packed vectors, by dim, or by dim and label where same. A block
    of vectors meets the blocks of the stated query set, each of these sent to every shard: the blocks are joined, not their rows."""
    key = ["dim", "label"] if same else ["dim"]
    left = packed(asked, key, QUERIES, True).toDF(*key, "qblock", *[f"q_{c.split()[0]}" for c in PACKED.split(", ")]).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    # Few bytes, much work: dealt to as many tasks as there are shards at least, and not put together again for being small.
    tasks = max(shards, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = (v.repartition(tasks, *key, "shard") for v in (left, right))
    pairs = left.hint("merge").join(right, [*key, "shard"]).select("dim", *[f"q_{c}" for c in ("ids", "labels", "matrix", "asked")], "ids", "labels", "matrix")

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                qi, ql, ids, labels = (np.frombuffer(x, np.int64) for x in (r.q_ids, r.q_labels, r.ids, r.labels))
                a, y = (np.frombuffer(m, np.int32).astype(np.int64).reshape(len(n), r.dim) for m, n in ((r.q_matrix, qi), (r.matrix, ids)))
                ask = np.frombuffer(r.q_asked, np.float64).reshape(-1, 4)
                i, j, score = survivors(a, y, np.ceil(ask[:, 2]))
                ok = (score <= ask[i, 1]) & ((ql[i] == labels[j]) == same) & (qi[i] != ids[j])
                i, j, score = i[ok], j[ok], score[ok]
                k = first(i, j, score, ids, most)
                i, j = i[k], j[k]
                yield pd.DataFrame({"anchor_id": qi[i], "low": ask[i, 0], "high": ask[i, 1], "id": ids[j], "score": score[k]})

    return pairs.mapInPandas(run, FOUND)


def sampled_scores(asked: DataFrame, sample: pd.DataFrame, same: bool, most: int) -> DataFrame:
    """asked (vec_id, label, dim, q, low, high) with best and sure: the best and the most-th best score in the window among the sample's rows, null if there are none or fewer."""
    by_dim = {d: (g["vec_id"].to_numpy(np.int64), g["label"].to_numpy(np.int64), np.array(g["q"].tolist(), np.int64)) for d, g in sample.groupby("dim")} if len(sample) else {}
    sent = asked.sparkSession.sparkContext.broadcast(by_dim)  # at most SAMPLE vectors

    def run(batches):
        for b in batches:
            best, sure = np.full(len(b), np.nan), np.full(len(b), np.nan)
            for d, g in b.groupby("dim"):
                if d in sent.value and d:
                    ids, labels, y = sent.value[d]
                    at = b.index.get_indexer(g.index)
                    s = np.array(g["q"].tolist(), np.int64).astype(float) @ y.T.astype(float)
                    inside = (s <= g["high"].to_numpy()[:, None]) & (s >= g["low"].to_numpy()[:, None]) & ((g["label"].to_numpy()[:, None] == labels[None, :]) == same) & (g["vec_id"].to_numpy()[:, None] != ids[None, :])
                    s = np.where(inside, s, -np.inf)
                    s = -np.partition(-np.pad(s, ((0, 0), (0, most)), constant_values=-np.inf), most - 1, axis=1)[:, :most]
                    best[at], sure[at] = s.max(axis=1), s.min(axis=1)
            # A little lower than computed: doubles of large integers are rounded.
            for v in (best, sure):
                v[np.isinf(v)] = np.nan
                v -= np.abs(v) * 1e-9
            b["best"], b["sure"] = best, sure
            yield b

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    out = asked.mapInPandas(run, kinds + ", best double, sure double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("best", "sure")})


def filled(asked: DataFrame, blocks: DataFrame, sample: pd.DataFrame, same: bool, most: int, shards: int) -> DataFrame:
    """(anchor_id, low, high, id, score, place): the first `most` rows, all if fewer, of every window low <= score <= high of asked.

    Thresholds are lowered from what the sample suggests to what it guarantees, then to low; only windows that aren't full go on."""
    steps = stored(sampled_scores(asked, sample, same, most), "asked")
    window = ["anchor_id", "low", "high"]
    named = steps.withColumnRenamed("vec_id", "anchor_id")
    out, todo = None, named.select(*window)
    for k, ask in enumerate((F.col("best"), F.col("sure"), F.col("low"))):
        now = named.join(todo, window, "left_semi").where(ask.isNotNull()).withColumnRenamed("anchor_id", "vec_id")
        now = now.withColumn("asked", F.array("low", "high", F.greatest(ask, F.col("low")), F.lit(0.0)))
        hits = search(now.select("vec_id", "label", "dim", "q", "asked"), blocks, same, most, shards)
        top = hits.groupBy(*window).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "id"))), 1, most).alias("found"))
        top = stored(top, "found")  # of a window, at most `most` rows a block
        full = top.where(F.size("found") == most) if k < 2 else top
        out = full if out is None else out.unionAll(full)
        todo = todo.join(full, window, "left_anti")
        if k < 2 and todo.isEmpty():
            break
    return out.select(*window, F.posexplode("found").alias("place", "f")).select(*window, "f.id", (-F.col("f.m")).alias("score"), (F.col("place") + 1).alias("place"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, dim, q; see quantised), vec_id distinct.

    anchors: a condition on vec_id. Positives of an anchor: the first rows of its label; for each, the first negatives, rows of other
    labels, with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, equal ones by vec_id.
    A positive whose window holds nothing gives no row; a negative score's window is empty. sample: vectors that set the first thresholds."""
    rows = stored(rows, "vectors")
    n = rows.count()
    shards = max(1, min(64, -(-n // block)), -(-n // (4 * block)))
    some = rows.withColumn("h", F.xxhash64(F.lit(13), "vec_id")).orderBy("h", "vec_id").limit(sample).drop("h").toPandas()  # a bounded sample: it only sets thresholds
    asks = rows.where(anchors)
    by_label = stored(packed(rows, ["dim", "label"], block), "blocks-label")
    # Scores below 0 have empty windows, so positives below 0 aren't asked for.
    wanted = asks.withColumns({"low": F.lit(0.0), "high": F.lit(float(1 << 62))})
    found = filled(wanted, by_label, some, True, positives, shards).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = stored(found, "positives")
    # The window's ends as whole scores: ceil(low * s / 100) and floor(high * s / 100); s is at least 0.
    ends = found.withColumns({"low": F.expr(f"cast(({low} * positive_score + 99) div 100 as double)"), "high": F.expr(f"cast(({high} * positive_score) div 100 as double)")})
    windows = ends.select("anchor_id", "low", "high").distinct().where("low <= high")
    wanted = windows.join(asks.withColumnRenamed("vec_id", "anchor_id"), "anchor_id").withColumnRenamed("anchor_id", "vec_id")
    mixed = stored(packed(rows, ["dim"], block), "blocks")
    hits = filled(wanted.select("vec_id", "label", "dim", "q", "low", "high"), mixed, some, False, negatives, shards)
    out = ends.join(hits, ["anchor_id", "low", "high"])
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
