"""Embedding near-duplicates by product quantisation (Jegou et al. 2011) over coarse inverted lists.

Vectors are compared only when their labels are equal and not null, by cosine in double precision. Only
vectors of one length are compared. Null and zero vectors and those with null or non-finite components link with nothing.

1. Equal vectors of a label are one class with a count; the smallest vec_id stands for it.
2. Coarse centroids and residual codebooks are fitted on at most SAMPLE classes, those with the smallest hash (a
   documented bound); every class is indexed: list, and one code byte for each of PARTS parts of its residual.
3. Links go both ways, so a class probes its own list and those after it, and leaves out only what can't hold a link: lists
   whose midway plane between their centroid and the class's own is farther than the threshold's distance, and lists whose
   nearest and farthest vectors from their centroid exclude one by the triangle inequality. No link is lost by that; in
   64 dimensions it may leave most lists.
4. Lists are cut in blocks of about BLOCK classes, on either side, so that no list or label is held by one task.
   Within a pair of blocks, asymmetric table lookups give distances to coded vectors; those up to the threshold's plus
   the vector's own quantisation error are candidates, so none is lost however the codes fit, and exact cosines decide. Counts are summed; only a spanning forest of the links leaves the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, hashed_sample, stored

COSINE = 0.93
SAMPLE, LIST_SIZE, MOST_LISTS = 16_384, 256, 1024
PARTS, CODES = 16, 256
BLOCK = 1024
#: Allowance for rounding in distances that exclude.
NEAR, NEAR_LOOKUP = 1e-6, 1e-4
#: Pairs whose exact cosines are taken at once.
AT_ONCE = 65_536


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(c))
            c[n > 0, d] = total[n > 0] / n[n > 0]
    return c


class Index:
    """Coarse centroids (lists, d) and codebooks (PARTS, codes, d / PARTS); it goes to the tasks, at most some MB."""

    def __init__(self, sample: np.ndarray, rows: int, radius: float, seed: int = 7):
        """rows: classes of the most frequent label, which make the number of lists."""
        rng = np.random.default_rng(seed)
        lists = int(np.clip(rows // LIST_SIZE, 1, min(MOST_LISTS, max(1, len(sample) // 16))))
        self.radius = radius
        self.coarse = _kmeans(sample, lists, 8, rng)
        self.apart = np.stack([np.sqrt(((self.coarse - c) ** 2).sum(axis=1)) for c in self.coarse])
        rest = sample - self.coarse[self.nearest(sample)]
        cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.cuts = list(zip(cuts, cuts[1:], strict=False))
        self.books = [_kmeans(rest[:, a:b], CODES, 6, rng) for a, b in self.cuts]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - 0.5 * (self.coarse**2).sum(axis=1)).argmax(axis=1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[lists]
        return np.stack([(rest[:, a:b] @ k.T - 0.5 * (k * k).sum(axis=1)).argmax(axis=1).astype(np.uint8) for (a, b), k in zip(self.cuts, self.books, strict=True)], axis=1)

    def errors(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors from what their codes stand for."""
        rest = x - self.coarse[lists]
        return np.sqrt(sum(((rest[:, a:b] - k[codes[:, p]]) ** 2).sum(axis=1) for p, ((a, b), k) in enumerate(zip(self.cuts, self.books, strict=True))))

    def far(self, x: np.ndarray) -> np.ndarray:
        """(n, lists) distances to the centroids."""
        return np.sqrt(np.maximum(((x * x).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1)) - 2 * x @ self.coarse.T, 0))

    def probes(self, far: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(n, lists) booleans: own list and later ones whose side of the midway plane is within the radius. far: from far()."""
        step = (far**2 - far[np.arange(len(far)), own][:, None] ** 2) / (2 * np.maximum(self.apart[own], 1e-6))
        return (step <= self.radius + NEAR) & (np.arange(len(self.coarse)) >= own[:, None])

    def lookup(self, q: np.ndarray, c: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances (vectors of list c, queries) by tables of q's residual against the codebooks, single precision.

        A table's row is a code, so that a vector's part takes a whole row of queries at once."""
        rest = (q - self.coarse[c]).astype(np.float32)
        out = np.zeros((len(codes), len(q)), np.float32)
        for p, ((a, b), k) in enumerate(zip(self.cuts, self.books, strict=True)):
            r, k = rest[:, a:b], k.astype(np.float32)
            table = (k * k).sum(axis=1)[:, None] + (r * r).sum(axis=1) - 2 * k @ r.T
            out += table[codes[:, p]]
        return out


def units(rows) -> np.ndarray:
    """Vectors of length one, in double precision; scaled by the largest component first, so that no square over- or underflows."""
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matched(queries: pd.DataFrame, data: pd.DataFrame, index: Index, cosine: float) -> pd.DataFrame:
    """A block of queries against a block of one list: links counted for each class, and the smallest class it reaches here.

    A pair of one list comes both ways and counts for its query; other pairs come once and count for both."""
    if not len(queries) or not len(data):
        return pd.DataFrame({"rep": [], "links": [], "root": []})
    q, x = units(queries["v"]), units(data["v"])
    codes = np.frombuffer(b"".join(data["codes"]), np.uint8).reshape(len(data), -1)
    here = int(data["list"].iloc[0])
    most = (index.radius + data["error"].to_numpy() + NEAR_LOOKUP) ** 2
    near = index.lookup(q, here, codes) <= most.astype(np.float32)[:, None]
    near &= np.abs(data["mid"].to_numpy()[:, None] - index.far(q)[:, here]) <= index.radius + NEAR
    j, i = np.nonzero(near)
    qi, dj = queries["rep"].to_numpy(), data["rep"].to_numpy()
    keep = qi[i] != dj[j]
    i, j = i[keep], j[keep]
    cuts = [slice(k, k + AT_ONCE) for k in range(0, len(i), AT_ONCE)]
    exact = np.concatenate([np.zeros(0, bool), *(np.einsum("nd,nd->n", q[i[k]], x[j[k]]) >= cosine for k in cuts)])
    i, j = i[exact], j[exact]
    links = np.bincount(i, data["copies"].to_numpy()[j], len(q)).astype(np.int64)
    other = queries["own"].to_numpy()[i] != here
    back = np.bincount(j[other], queries["copies"].to_numpy()[i[other]], len(x)).astype(np.int64)
    names, place = np.unique(np.concatenate([qi, dj]), return_inverse=True)
    root = forest(np.stack([place[i], place[len(qi) + j]], axis=1), len(names)) if len(i) else np.arange(len(names))
    linked = np.unique(np.concatenate([place[i], place[len(qi) + j]]))
    count = np.zeros(len(names), np.int64)
    np.add.at(count, place, np.concatenate([links, back]))
    return pd.DataFrame({"rep": names[linked], "links": count[linked], "root": names[root[linked]]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label); other columns are dropped.

    Vectors are compared with those of their label and of their length. vec_id is unique: rows that repeat it give a row each, share their links and are one node. n_links counts the other rows
    linked directly, copies included. A row without vec_id links with nothing, has no component and isn't kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = rows.where(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # Vectors meet those of their label and length. Lengths between two powers of two are compared together, padded with zeros.
    scale = F.ceil(F.log2(F.size("v"))).cast("int")
    lengths = good.groupBy(scale.alias("scale")).agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least")).orderBy("scale").collect()  # a row for each power of two
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    linked = None
    for r in lengths:
        some = good.where(scale == r.scale)
        if r.most == r.least:
            one = _linked(some, cosine).select("label", "v", "n_links", "component_id")
        else:
            key = F.concat(F.col("label").cast("string"), F.lit(":"), F.size("v").cast("string"))
            zeros = F.array_repeat(F.lit(0).cast(good.schema["v"].dataType.elementType), F.lit(r.most) - F.size("v"))
            named = stored(some.select("vec_id", "label", "v", key.alias("key"), F.concat("v", zeros).alias("padded")), "padded")
            found = _linked(named.select("vec_id", F.col("key").alias("label"), F.col("padded").alias("v")), cosine).toDF("key", "padded", "n_links", "component_id")
            one = named.select("label", "v", "key", "padded").distinct().join(found, ["key", "padded"]).select("label", "v", "n_links", "component_id")
        linked = one if linked is None else linked.unionAll(one)
    # Stored, so that a vector of many copies is split as any skewed key; vectors outside the comparison meet no class.
    linked = linked if len(lengths) == 1 and lengths[0].most == lengths[0].least else stored(linked, "linked")
    out = rows.join(linked, ["label", "v"], "left")
    there = F.col("vec_id").isNotNull()
    component = F.when(there, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(there, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(good: DataFrame, cosine: float) -> DataFrame:
    """(label, v, n_links, component_id), stored, for each class of equal vectors of good (vec_id, label, v), all of one length."""
    good = stored(good, "vectors")
    classes = stored(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    largest, n = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    sample = hashed_sample(classes, "rep", SAMPLE, n).select("v").toPandas()
    index = Index(units(sample["v"]), largest, float(np.sqrt(2 - 2 * cosine)))
    spark = good.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def coded(batches):
        for b in batches:
            if b.num_rows:
                x = units(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                own = sent.value.nearest(x)
                codes = sent.value.codes(x, own)
                error = sent.value.errors(x, own, codes)
                far = sent.value.far(x)
                probes = [[{"list": int(c), "far": float(f[c])} for c in np.flatnonzero(p)] for p, f in zip(sent.value.probes(far, own), far, strict=True)]
                mid = far[np.arange(len(x)), own]
                made = [pa.array(own.astype(np.int32)), pa.array(mid), pa.array(error), pa.array([bytes(c) for c in codes], pa.binary()), pa.array(probes, pa.list_(pa.struct([("list", pa.int32()), ("far", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=["label", "v", "rep", "copies", "list", "mid", "error", "codes", "probes"])

    kind, array = (classes.schema[c].dataType.simpleString() for c in ("label", "v"))
    coded_ = classes.select("label", "v", "rep", "copies").mapInArrow(coded, f"label {kind}, v {array}, rep long, copies long, list int, mid double, error double, codes binary, probes array<struct<list:int,far:double>>")
    coded_ = stored(coded_, "coded")
    blocks = coded_.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("mid").alias("inner"), F.max("mid").alias("outer"))
    blocks = stored(blocks, "blocks")
    asks = coded_.select("label", "v", "rep", "copies", F.col("list").alias("own"), F.explode("probes").alias("p")).select("label", "v", "rep", "copies", "own", "p.list", "p.far")
    asks = asks.join(blocks, ["label", "list"]).where(F.col("far").between(F.col("inner") - index.radius - NEAR, F.col("outer") + index.radius + NEAR)).drop("far", "blocks", "inner", "outer")
    sides = asks.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sides"))
    both = stored(blocks.join(sides, ["label", "list"]), "cuts")
    asks = asks.join(both, ["label", "list"]).withColumn("side", F.pmod(F.xxhash64("rep"), "sides").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    data = coded_.join(both, ["label", "list"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    key = ["label", "list", "block", "side"]
    asks, data = asks.select(*key, "rep", "v", "own", "copies").toDF(*key, "rep", "v", "own", "copies"), data.select(*key, "rep", "v", "mid", "error", "codes", "copies").toDF(*key, "rep", "v", "mid", "error", "codes", "copies")
    found = asks.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(lambda q, d: _matched(q, d, sent.value, cosine), "rep long, links long, root long")
    found = stored(found, "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()).select(F.col("node").alias("rep"), "component")
    per_class = classes.select("label", "v", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    per_class = per_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return stored(per_class, "linked")
