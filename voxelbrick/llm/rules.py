"""Quality rules whose cutoffs are risk-controlled, DataFrame functions only.

Fixed base rules first (too few words, too much repeated). For the texts that pass them, each rule of RULES gives a
text a grade, an integer that is higher the worse it looks. A stratum's labelled texts are split in two folds by a hash
of doc_id:

* The tuning fold proposes. Level 0 cuts each rule above the worst grade of any good text, level j where j / LEVELS of RISK of
  the good texts go; a rule is left out of a level where it doesn't take at least LIFT times as large a share of the bad texts.
* The other fold decides. At a level, k of n good texts would be rejected by any rule. If the true rate of false rejections were
  RISK or more, so few would be seen with a probability of at most P(Bin(n, RISK) <= k): the exact (Clopper-Pearson) bound.
  Levels are tested in order and only as far as they pass; the strata share the error: each tests at ERROR / number of strata
  (Bonferroni). So with probability 1 - ERROR the rate is below RISK in every stratum at once.

Of the levels that pass, that with the largest gain on the tuning fold (share of bad less share of good texts rejected) is taken, the
most lenient of equals. A stratum with too few labels, or none, rejects nothing beyond the base rules.

Counts run over all labelled texts; no sample is taken. What is joined with the documents is one row a stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RISK = 0.02
ERROR = 0.05
LEVELS = 10
LIFT = 2
TOP = 1000
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words")


def repeated_words(words: Column) -> Column:
    """How many of words (array<string>) lie in a window of three that is found twice or more, the first place included.

    A window is a 64-bit hash of its words; windows are sorted with their places, and equal neighbours repeat: time goes with n log n.
    Two different windows of a text of 20,000 words have one hash with a probability of 1e-11."""
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    # The arrays of one element bind a name: what is inside the lambda is computed once a text.
    bound = F.transform(
        F.array(F.sort_array(windows)),
        lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
        )))),
    )
    return F.when(last >= 0, F.get(bound, F.lit(0))).otherwise(0).cast("long")


def statistics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, the BASE counts, n_lines (lines with a word) and base_failed of each row of docs. Null text: none of anything; null stratum: ''."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    rows = rows.select("*", F.filter(F.split("text", _SPACE), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"))
    bare = F.translate("text", " \t\n\x0b\x0c\r", "")
    out = rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def grades() -> Column:
    """The grades of RULES, in order, from 0 to TOP: whole numbers, so that every engine agrees on them."""
    per = lambda top, by: F.coalesce(F.least(F.lit(TOP), F.expr(f"({top}) div nullif({by}, 0)")), F.lit(0)).cast("int")
    length = per("20 * word_chars", "n_words")
    return F.array(per("100 * n_symbols", "n_words"), per("1000 * n_dup_lines", "n_lines"), per("1000 * n_repeat_words", "n_words"), length, (F.lit(TOP) - length).cast("int"))


def tail(k: Column, n: Column, risk: float) -> Column:
    """P(Bin(n, risk) <= k), summed in logarithms; 1 where k is above the mean, as the sum is then of no use to the test."""
    import math

    odds, start = math.log(risk / (1 - risk)), n.cast("double") * math.log1p(-risk)

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1).cast("double") / i) + odds
        top = F.greatest(a["s"], t)
        return F.struct(t.alias("t"), (top + F.log1p(F.exp(-F.abs(a["s"] - t)))).alias("s"))

    summed = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(start.alias("t"), start.alias("s")), add, lambda a: F.exp(a["s"]))
    return F.when(k > n * risk, 1.0).otherwise(F.least(summed, F.lit(1.0)))


def proposed(known: DataFrame, risk: float = RISK, levels: int = LEVELS, lift: float = LIFT) -> DataFrame:
    """(stratum, cuts) from known (stratum, good, grades) of the tuning fold: cuts[level][rule] is the grade above which a text goes, null if none."""
    each = known.select("stratum", "good", F.posexplode("grades").alias("rule", "grade"))
    counts = each.groupBy("stratum", "rule", "grade").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    own, above = Window.partitionBy("stratum", "rule"), Window.partitionBy("stratum", "rule").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most TOP + 1 rows
    sums = counts.select("stratum", "rule", "grade", F.sum("g").over(own).alias("n_good"), F.sum("b").over(own).alias("n_bad"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in "gb"])
    steps = sums.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).where(F.col("g") <= F.floor(F.col("n_good") * F.col("level") * (risk / levels)))
    best = steps.groupBy("stratum", "rule", "level").agg(F.min(F.struct("grade", "g", "b", "n_good", "n_bad")).alias("c"))
    useful = (F.col("c.b") > 0) & (F.col("c.b") * F.col("c.n_good") >= lift * F.col("c.g") * F.col("c.n_bad"))
    rows = best.select("stratum", "level", F.struct("rule", F.when(useful, F.col("c.grade")).alias("cut")).alias("r"))
    rows = rows.groupBy("stratum", "level").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["cut"]).alias("cuts"))  # a row for each rule
    return rows.groupBy("stratum").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "cuts"))), lambda r: r["cuts"]).alias("cuts"))  # a row for each level


def beyond(grades: Column, cuts: Column) -> Column:
    """Whether any grade is above its cut."""
    return F.exists(F.zip_with(grades, cuts, lambda g, c: F.coalesce(g > c, F.lit(False))), lambda x: x)


def thresholds(known: DataFrame, risk: float = RISK, error: float = ERROR, levels: int = LEVELS, lift: float = LIFT) -> DataFrame:
    """(stratum, level, cuts, n_good, bound_p) of strata where a level passes; known: doc_id, stratum, good, grades of labelled texts that pass the base rules."""
    tuning = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "8"
    known = stored(known.select("stratum", "good", "grades", tuning.alias("tuning")), "labelled")
    cuts = stored(proposed(known.where("tuning"), risk, levels, lift), "cuts")
    severity = F.array_position(F.transform("cuts", lambda c: beyond(F.col("grades"), c)), F.lit(True)) - 1  # -1: never
    counts = known.join(cuts, "stratum").select("stratum", "tuning", "good", severity.cast("int").alias("level")).groupBy("stratum", "tuning", "good", "level").agg(F.count("*").alias("n"))
    at = F.sequence(F.lit(0), F.lit(levels))
    shares = counts.withColumn("at", F.explode(at)).groupBy("stratum", "at").agg(*[
        F.sum(F.when(F.expr(f"{'' if t else 'not '}tuning and {'' if g else 'not '}good") & hit, F.col("n")).otherwise(0)).alias(f"{'t' if t else 'c'}{'g' if g else 'b'}{name}")
        for t in (True, False) for g in (True, False) for name, hit in (("", F.col("level").between(0, F.col("at"))), ("_all", F.lit(True)))
    ])
    strata = known.select("stratum").distinct().count()
    tested = shares.withColumn("p", F.when(F.col("cg_all") > 0, tail(F.col("cg"), F.col("cg_all"), risk)).otherwise(1.0))
    # The rate of rejections, and with it p, only rises with the level: what passes is a beginning of the sequence.
    passed = tested.where(F.col("p") <= error / max(strata, 1))
    gain = F.coalesce(F.col("tb") / F.nullif("tb_all", F.lit(0)), F.lit(0.0)) - F.coalesce(F.col("tg") / F.nullif("tg_all", F.lit(0)), F.lit(0.0))
    chosen = passed.groupBy("stratum").agg(F.min(F.struct((-gain).alias("k"), "at", "cg_all", "p")).alias("c"))
    return stored(chosen.join(cuts, "stratum").select("stratum", F.col("c.at").alias("level"), F.get("cuts", F.col("c.at")).alias("cuts"), F.col("c.cg_all").alias("n_good"), F.col("c.p").alias("bound_p")), "thresholds")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """One row for each row of docs (doc_id, text, stratum): doc_id, n_words, the BASE counts, base_failed, kept, then rule (the first that rejects it) and level.

    labels: doc_id, quality 0 or 1; rows without a value don't count, of several for a document the highest does. Repeated rows each
    give a row; a null doc_id has no label. An empty table gives no rows; without labels only the base rules reject. options: risk, error, levels, lift."""
    rows = stored(statistics(docs, stratum), "statistics")
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") >= 1).alias("good"))
    known = rows.where(~F.col("base_failed")).join(marks, "doc_id").select("doc_id", "stratum", "good", grades().alias("grades"))
    cut = thresholds(known, **options)
    judged = rows.join(cut.select("stratum", "level", "cuts"), "stratum", "left")
    hit = F.array_position(F.zip_with(grades(), F.col("cuts"), lambda g, c: F.coalesce(g > c, F.lit(False))), F.lit(True))
    name = F.when(F.col("base_failed"), "base").when(F.coalesce(hit, F.lit(0)) > 0, F.get(F.array(*[F.lit(r) for r in RULES]), (hit - 1).cast("int")))
    judged = judged.withColumn("rule", name)
    return judged.select("doc_id", "n_words", *BASE, "base_failed", F.col("rule").isNull().alias("kept"), "rule", "level")
