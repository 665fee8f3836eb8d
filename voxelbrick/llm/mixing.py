"""Mixing sources to target weights by pivotal dependent rounding (Deville and Tille 1998), DataFrame functions only.

A source's target in words over its size gives each of its documents the same expected number of copies. The
integral part is taken; the fractions are rounded in pairs: words are moved at random from one document to the
other until one fraction is 0 or 1, which leaves the pair's words as they were and each expectation unchanged.
The undecided document meets the next one. Blocks of about BLOCK documents of one source do this side by side;
their undecided ones form the next level's blocks, a reduction tree of fan-in BLOCK, so a hot source only makes
more blocks. At the root one document per source goes to the nearer integer: a source's words miss its target by at
most half of that document's size.

Null or empty texts have size 0 and are never taken (copies 0). A null source is a source, ordered last. Repeated
(doc_id, size) rows of a source are rounded together and share the copies as evenly as integers can. Choices are
hashes of doc_id, size and seed: reruns agree, whatever the partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
SEED = 20240607
_EPS = 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of a column over the rows before in order: inside range partitions, plus the partitions before."""
    cut = stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = cut.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).select("part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"base_{k}") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(before, "part").select("*", *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"base_{k}")).alias(k) for k, c in sums.items()])
    return out.drop("part", *[f"base_{k}" for k in sums])


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with rank, weight, target: share of all words by weight, none above most times its size.

    rank is by source's code points from 0, null last. In order of cap over weight, the capped sources come first: the level
    of the others follows from running sums, and the first source that it leaves below its cap decides it."""
    ranked = _running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "ranked")
    total, sum_weight, highest = ranked.agg(F.sum("source_size"), F.sum("weight"), F.max(F.col("cap") / F.col("weight"))).first()
    ratio = F.col("cap") / F.col("weight")
    steps = _running(ranked.withColumn("ratio", ratio), [F.col("ratio"), F.col("rank")], {"capped": F.col("cap"), "used": F.col("weight")})
    level = (F.lit(float(share * (total or 0))) - F.col("capped")) / (F.lit(float(sum_weight or 0)) - F.col("used"))
    first = steps.withColumn("level", level).where(F.col("level") <= F.col("ratio")).agg(F.min(F.struct("ratio", "rank", "level")).alias("f")).first().f
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(float(first.level if first else highest or 0.0)))).drop("cap")


def _uniform(*key: Column) -> Column:
    return (F.xxhash64(*key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def _block(units: Column) -> Column:
    """Folds an array of struct<r, id, f, w>: out (struct<id, c>) are decided, (id, f, w) is the one left."""
    first = F.element_at(units, 1)
    kind = "array<struct<id:struct<doc_id:bigint,size:bigint>,c:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), first["id"].alias("id"), first["f"].alias("f"), first["w"].alias("w"))

    def meet(a: Column, x: Column) -> Column:
        """a and x meet. Up: words go from x to a. Each side ends at 0 or 1, or stays."""
        a_up, a_down, x_up, x_down = (1 - a["f"]) * a["w"], a["f"] * a["w"], (1 - x["f"]) * x["w"], x["f"] * x["w"]
        up_by, down_by = F.least(a_up, x_down), F.least(a_down, x_up)
        up = x["r"] * (up_by + down_by) < down_by
        a_done = F.when(up, a_up <= x_down).otherwise(a_down <= x_up)
        gives = lambda who, c: F.struct(who["id"].alias("id"), c.cast("int").alias("c"))
        done = F.when(a_done, gives(a, up)).otherwise(gives(x, ~up))
        moved = F.when(up, up_by).otherwise(-down_by)
        return F.struct(
            F.concat(a["out"], F.array(done)).alias("out"),
            F.when(a_done, x["id"]).otherwise(a["id"]).alias("id"),
            F.when(a_done, x["f"] - moved / x["w"]).otherwise(a["f"] + moved / a["w"]).alias("f"),
            F.when(a_done, x["w"]).otherwise(a["w"]).alias("w"),
        )

    return F.aggregate(F.slice(units, 2, F.size(units)), start, meet)


def rounded(units: DataFrame, largest: int, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """units (rank, many, id struct<doc_id, size>, f in (0,1), w) to (rank, id, c 0 or 1).

    many is at least the units of a source, largest the largest of these: they give the number of blocks, so that no
    step needs a source's rows together."""
    decided, level, now = [], 0, units
    while True:
        one = now.withColumn("many", F.ceil(F.col("many") / block)).withColumn("r", _uniform(F.lit(seed + level), "rank", "id"))
        one = one.withColumn("block", F.pmod(F.xxhash64(F.lit(seed - 1 - level), "id"), F.col("many")))
        folded = one.groupBy("rank", "many", "block").agg(_block(F.sort_array(F.collect_list(F.struct("r", "id", "f", "w")))).alias("x"))
        folded = stored(folded, f"fold{level}")
        decided.append(folded.select("rank", F.inline("x.out")))
        now = folded.select("rank", "many", "x.id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x.f")).alias("f"), "x.w")
        level += 1
        largest = -(-largest // block)
        if largest <= 1:
            break
    decided.append(now.select("rank", "id", (F.col("f") >= 0.5).cast("int").alias("c")))
    return reduce(DataFrame.unionAll, decided)


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


MADE = ("size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source) to one row per document: doc_id, size, source_size, target, taken, then source and copies.

    options: weights, share, most, seed. Other columns are dropped. An empty table gives no rows."""
    return _mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns, and size, source_size, target, taken, copies (replaced if there).

    docs' columns may have any other names: they travel as one struct."""
    kept = [c for c in docs.columns if c not in MADE]
    rows = docs.select(F.struct(*kept).alias("doc"), _size(F.col("text")).alias("size"))
    same = Window.partitionBy("doc.source", "doc.doc_id", "size").orderBy("doc.text")
    rows = rows.withColumn("nth", F.row_number().over(same).cast("long"))
    took = _mixed(docs.select("doc_id", "text", "source"), **options).where("copies > 0").select(*[F.col(c).alias(f"t_{c}") for c in ("nth", "doc_id", "source", *MADE)])
    on = F.col("doc.source").eqNullSafe(F.col("t_source")) & F.col("doc.doc_id").cast("long").eqNullSafe(F.col("t_doc_id")) & (F.col("size") == F.col("t_size")) & (F.col("nth") == F.col("t_nth"))
    return rows.join(took, on).select(*[F.col("doc")[c].alias(c) for c in kept], *[F.col(f"t_{c}").alias(c) for c in MADE])


def _mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size(F.col("text")).alias("size"))
    units = stored(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "units")
    goal = stored(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units")), weights, share, most), "targets")
    largest = goal.agg(F.max("units")).first()[0] or 0
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    x = F.when(F.col("size") > 0, per * F.col("rows")).otherwise(0.0)
    units = units.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = units.withColumn("base", F.floor(x + _EPS)).withColumn("f", x - F.col("base"))
    open_ = units.where(F.col("f") > _EPS).select("rank", F.col("units").alias("many"), F.struct("doc_id", "size").alias("id"), "f", F.col("size").cast("double").alias("w"))
    chosen = rounded(open_, largest, seed).select(F.col("rank").alias("k"), F.col("id.doc_id").alias("d"), F.col("id.size").alias("z"), "c").where("c = 1")
    units = units.join(chosen, (F.col("rank") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")), "left")
    units = units.withColumn("all", F.col("base") + F.coalesce("c", F.lit(0))).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    copies = F.floor(F.col("all") / F.col("rows")) + (F.col("nth") <= F.col("all") % F.col("rows")).cast("long")
    return units.select("nth", "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
