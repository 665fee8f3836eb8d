"""Near-duplicate texts by HyperMinHash (Yu and Weber 2017): banded compressed registers, then exact sets.

A text's set is its distinct k-word shingles (A-Z in lower case; fewer words make one shingle; no word: empty,
linked with nothing). Shingles are dealt to BUCKETS by their hash; SEEDS multiplicative orders give each bucket
its registers: the least value's leading zeros (5 bits) and MANTISSA bits after its first one, a byte. A band is ROWS
registers of one bucket. Two sets of Jaccard similarity s agree in a register of bucket g with probability s_g,
and some bucket has s_g >= s, so that with 48 bands of 7 a pair at 0.8 is missed with about 1e-5.

Steps, each of them written to the shared folder:
1. sketch: one map over the texts. Equal sets are one class from here on, its smallest id stands for it.
2. links: members of a band's bucket are paired with its smallest and its largest member, not all with all;
   pairs whose collision-corrected estimate is SIGMAS deviations below the threshold go (of pairs at the threshold about
   3e-7), the rest are counted on full sets.
3. Components of the links. A bucket with members in several components isn't settled: its members outside the component
   that has most of it are compared with all its members. That is done in blocks of bounded rows and bytes, on either side,
   where matrix products and an inverted list count intersections exactly; only a spanning forest of the links leaves a task.
   Buckets of one largest component are compared as one unit, each set sent once a block, unless that makes over MERGED
   times the comparisons that they make one by one.
4. Components again, and each class's members take its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, dropped, forest, map_texts, mix, shingle_hashes, stored, texts_of

BUCKETS, SEEDS, ROWS = 4, 84, 7
MANTISSA = 3
REGISTERS = BUCKETS * SEEDS
BANDS = REGISTERS // ROWS
#: Pairs are confirmed from this many standard deviations of the estimate below the threshold.
SIGMAS = 5.0
#: Comparisons of merged buckets for each one of theirs.
MERGED = 4
#: Sets and shingles in a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
#: Entries of a block's inverted list, and columns of its matrices, that are counted at once.
AT_ONCE, COLUMNS = 1 << 21, 1024
_MULTIPLIERS = (np.random.default_rng(20240607).integers(0, 1 << 32, SEEDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_EMPTY = np.uint8(0xFF)


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS bytes for sorted distinct 64-bit hashes, bucket by bucket; an empty bucket's are _EMPTY."""
    out = np.full((BUCKETS, SEEDS), 0xFFFFFFFF, np.uint32)
    cut = np.searchsorted(shingles, np.arange(BUCKETS + 1, dtype=np.uint64) * np.uint64((1 << 64) // BUCKETS)) if len(shingles) else np.zeros(BUCKETS + 1, int)
    cut[-1] = len(shingles)
    low = shingles.astype(np.uint32)
    for g in range(BUCKETS):
        for i in range(cut[g], cut[g + 1], 2048):
            part = low[i : min(i + 2048, cut[g + 1])]
            np.minimum(out[g], (_MULTIPLIERS * part).min(axis=1), out=out[g])
    full = np.repeat(np.diff(cut) > 0, SEEDS)
    v = out.ravel()
    length = np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    zeros = 32 - length
    shift = np.maximum(length - 1 - MANTISSA, 0)
    mantissa = (v.astype(np.int64) >> shift) & ((1 << MANTISSA) - 1)
    return np.where(full, np.minimum((np.minimum(zeros, 31) << MANTISSA) | mantissa, 254).astype(np.uint8), _EMPTY)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; 0 for a band of an empty bucket."""
    rows = regs.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, i])
    return np.where(regs.reshape(BANDS, ROWS)[:, 0] == _EMPTY, np.uint64(0), h | np.uint64(1))


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates for rows of registers and set sizes, corrected for chance collisions of compressed registers."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = 0.169919487159739093975 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (same - chance) / (1 - chance)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(id, h1, h2, n, regs): the set's 128-bit digest, size and registers. docs: (id long, text)."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, n, regs = [], [], [], []
        for t in texts_of(b.column(1)):
            s = shingle_hashes(t, k)
            n.append(len(s))
            h1.append(int(mix(s).sum(dtype=np.uint64)) - (1 << 63))
            h2.append(int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) - (1 << 63))
            regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(regs, pa.binary())], names=["id", "h1", "h2", "n", "regs"])

    return map_texts(docs, fn, "id long, h1 long, h2 long, n long, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id) for each band of each representative that has shingles in it."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([band_keys(np.frombuffer(r, np.uint8)) for r in b.column(1).to_pylist()])
            ids = np.repeat(np.asarray(b.column(0)), BANDS)
            flat = keys.ravel()
            keep = flat != 0
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep].view(np.int64)), pa.array(ids[keep])], names=["key", "id"])

    return reps.select("id", "regs").mapInArrow(run, "key long, id long")


def _likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose similarity may reach least: by the estimate and SIGMAS deviations, and by the sizes."""
    one = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "na", "ra", "nb", "rb")

    def run(batches):
        for x in batches:
            if not x.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (3, 5))
            na, nb = (np.asarray(x.column(c)).astype(np.float64) for c in (2, 4))
            used = ((ra != _EMPTY) | (rb != _EMPTY)).sum(axis=1)
            # Buckets of few shingles differ in size, though each counts alike in the estimate.
            slack = SIGMAS * np.sqrt(least * (1 - least) * (1 / used + (BUCKETS / np.minimum(na, nb)) ** 2))
            high = np.minimum(estimate(ra, rb, na, nb) + slack, np.minimum(na, nb) / np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(high >= least))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, set): sorted shingle hashes, 8 bytes each, of the documents in ids."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_hashes(t, k) for t in texts_of(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["id", "n", "set"])

    return map_texts(docs.join(ids, "id", "left_semi").select("id", "text"), fn, "id long, n long, set binary").where("n > 0").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on the full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for i in range(x.num_rows):
                p, q = np.frombuffer(x.column(2)[i].as_py(), np.uint64), np.frombuffer(x.column(3)[i].as_py(), np.uint64)
                union = len(np.union1d(p, q))
                keep[i] = 100 * (len(p) + len(q) - union) >= percent * union
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _entries(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and the row each is of, ordered by shingle."""
    each = [np.frombuffer(s, np.uint64) for s in sets]
    shingle, row = np.concatenate(each), np.repeat(np.arange(len(each)), [len(s) for s in each])
    order = np.argsort(shingle, kind="stable")
    return shingle[order], row[order]


def intersections(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """(len(a), len(b)) sizes of the intersections. Shingles of many pairs are counted by matrix products, others by an inverted list."""
    out = np.zeros((len(a), len(b)), np.float32)
    (sa, ra), (sb, rb) = _entries(a), _entries(b)
    ua, fa, ca = np.unique(sa, return_index=True, return_counts=True)
    ub, fb, cb = np.unique(sb, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    fa, ca, fb, cb = fa[ia], ca[ia], fb[ib], cb[ib]
    common = ca * cb * 32 > out.size
    dense = np.flatnonzero(common)
    for at in range(0, len(dense), COLUMNS):
        part = dense[at : at + COLUMNS]
        sides = []
        for size, rows, first, count in ((len(a), ra, fa[part], ca[part]), (len(b), rb, fb[part], cb[part])):
            column = np.repeat(np.arange(len(part)), count)
            where = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            m = np.zeros((size, len(part)), np.float32)
            m[rows[where], column] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    fa, ca, fb, cb = fa[~common], ca[~common], fb[~common], cb[~common]
    # One piece for each shingle and row of a: it meets the shingle's rows of b.
    here = np.repeat(fa - np.concatenate([[0], np.cumsum(ca)[:-1]]), ca) + np.arange(ca.sum()) if len(ca) else np.zeros(0, int)
    first, count = np.repeat(fb, ca), np.repeat(cb, ca)
    total = np.cumsum(count)
    start = 0
    while start < len(here):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_ONCE)))
        n = count[start:end]
        j = np.repeat(first[start:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out += np.bincount(np.repeat(ra[here[start:end]], n) * len(b) + rb[j], minlength=out.size).reshape(out.shape)
        start = end
    return out


def _across(strays: pa.Table, rows: pa.Table, percent: int) -> pa.Table:
    """Links between a block of strays and a block of rows (component, n, set) in different components: (a, b), b the least component that a reaches here."""
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not strays.num_rows or not rows.num_rows:
        return empty
    get = lambda t, c: t.column(c).combine_chunks()
    ca, cb, na, nb = (np.asarray(get(t, c)) for c in ("component", "n") for t in (strays, rows))
    same = intersections(get(strays, "set").to_pylist(), get(rows, "set").to_pylist()).astype(np.int64)
    i, j = np.nonzero((100 * same >= percent * (na[:, None] + nb - same)) & (ca[:, None] != cb))
    if not len(i):
        return empty
    names, place = np.unique(np.concatenate([ca[i], cb[j]]), return_inverse=True)
    root = forest(np.unique(place.reshape(2, -1).T, axis=0), len(names))
    return pa.table({"a": names, "b": names[root]})


def _unsettled(met: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket of met. Buckets of up to three members were compared whole."""
    known = met.where("size > 3").select("key", "id").join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
    known = stored(known.select("key", "id", F.coalesce("component", "id").alias("component")), "known")
    sides = known.groupBy("key", "component").agg(F.count("*").alias("rows"))
    sides = sides.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("all"), F.max("rows").alias("most"), F.count("*").alias("sides"))
    sides = stored(sides.where("sides > 1").select("key", "main", (F.col("all") * (F.col("all") - F.col("most"))).alias("cost")), "sides")
    open_ = stored(known.join(sides.drop("cost"), "key"), "open")
    stray = (F.col("component") != F.col("main")).cast("long")
    merged = stored(open_.select("main", "id", "component").distinct(), "merged")
    costs = merged.groupBy("main").agg((F.count("*") * F.sum(stray)).alias("at_once")).join(sides.groupBy("main").agg(F.sum("cost").alias("apart")), "main")
    costs = stored(costs.select("main", (F.col("at_once") <= MERGED * F.col("apart")).alias("merge")), "costs")
    units = merged.withColumn("key", F.lit(0).cast("long")).join(costs.where("merge"), "main").unionByName(open_.join(costs.where("not merge"), "main")).drop("merge")
    units = stored(units.join(sets.select("id", "n").groupBy("id").agg(F.max("n").alias("n")), "id"), "units")

    blocks = lambda rows, n: F.ceil(F.greatest(rows / BLOCK_ROWS, n / BLOCK_SHINGLES)).cast("int")
    cuts = units.groupBy("main", "key").agg(blocks(F.sum(stray), F.sum(stray * F.col("n"))).alias("lefts"), blocks(F.count("*"), F.sum("n")).alias("rights"))
    dealt = units.drop("n").join(stored(cuts, "cuts"), ["main", "key"]).withColumn("left", F.pmod(F.xxhash64("id"), "lefts")).withColumn("right", F.pmod(F.xxhash64(F.lit(1), "id"), "rights"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    where = ["main", "key", "left", "right"]
    names = [*where, "component", "n", "set"]
    strays = dealt.where("component <> main").withColumn("right", each("rights")).join(sets, "id").select(*names).toDF(*names)
    rows = dealt.withColumn("left", each("lefts")).join(sets, "id").select(*names).toDF(*names)
    found = strays.groupBy(*where).cogroup(rows.groupBy(*where)).applyInArrow(lambda s, r: _across(s, r, percent), "a long, b long")
    found = stored(found, "found")
    for t in (known, sides, open_, merged, costs, units):
        dropped(t)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs: kept is doc_id = component_id.

    Null texts count as empty, other columns are ignored. Rows of one doc_id each give a row and are one document: its sets are compared
    alike. A row without doc_id has no component of its own and isn't kept."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = stored(sketch(docs, k), "sketches")
    same = sketches.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    same = stored(same.drop("copies"), "same")
    members = stored(sketches.select("id", "h1", "h2", "n").join(same, ["h1", "h2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    reps = sketches.where("n > 0").select("id", "n", "regs").join(members.where("n > 0 and id = rep").select("id"), "id", "left_semi").distinct()
    reps = stored(reps, "reps")
    dropped(sketches)
    dropped(same)
    bands = stored(_bands(reps), "bands")
    ends = bands.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")).where("first < last")
    ends = stored(ends, "ends")
    met = stored(bands.join(ends, "key"), "met")
    dropped(bands)
    dropped(ends)

    both = F.array(F.struct(F.col("first").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("last").alias("b")))
    pairs = met.select(F.explode(both).alias("p")).select("p.*").where("a < b").distinct()
    likely = stored(_likely(pairs, reps, percent / 100), "likely")
    dropped(reps)
    ids = likely.select(F.explode(F.array("a", "b")).alias("id")).unionAll(met.where("size > 3").select("id")).distinct()
    sets = stored(_sets(docs, ids, k), "sets")
    links = stored(_linked(likely, sets, percent), "links")
    parts = stored(components(links), "parts")
    found = _unsettled(met, parts, sets, percent)
    for t in (likely, links, met, sets):
        dropped(t)
    if found.take(1):
        parts = stored(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found)), "parts")
    dropped(found)
    out = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    # A class's smallest id stands for it, so a component's smallest representative is its smallest member.
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
