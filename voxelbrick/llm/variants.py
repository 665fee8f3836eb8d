"""Spelling variants by a dictionary of trie-node pairs.

Every distinct word has a path in a trie of the words and one in a trie of the reversed words. All nodes are numbered, so a
prefix and a suffix are two integers, equal if and only if the strings are. A word without its character i is the pair
(node of the prefix of length i, node of the suffix after i); a whole word cut at i is the pair (prefix of i, suffix from
i). Two words that differ in one replaced character share a skipped pair, two that differ in an inserted one share a skipped
pair of the longer and a cut pair of the shorter. Pairs are exact, so nothing is verified and nothing is missed.

Numbering: words are range-partitioned in code-point order; in a part, a word's nodes are those of the word before as far as
their common prefix goes, and new ones after it. What crosses a border between parts is the path of one word: the driver
gets two words a part, and hands each part its first number and the numbers of the prefixes that it shares with the part before.

A pair's group holds at most one word for each character of the alphabet, and one cut word: it needs no splitting. Groups
give their members a count and their best neighbour, never pairs of members. A replaced character is at one place; of
the places where a doubled character can be left out only the first counts, so each neighbour is counted once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

SHORTEST = 7
LEAST = 2
RATIO = 10
PART = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, drop_every: int | None = 31) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF) of at least `shortest` code points, A-Z in lower case, found `least` times or more.

    drop_every: runs whose crc32 of '<doc_id>:<run>' it divides lose one code point (the contract's planted misspellings); None: none do.
    Null texts have no words, a null doc_id is written as nothing. Repeated rows count as often as they are there."""
    runs = docs.select(F.col("doc_id").cast("string").alias("d"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(rf"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("word"))
    if drop_every:
        h = F.crc32(F.concat(F.coalesce("d", F.lit("")), F.lit(":"), "word").cast("binary"))
        runs = runs.withColumn("h", h)
        k = (F.col("h") % F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), k), F.substring("word", k + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % drop_every == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    k = 0
    for x, y in zip(a, b):  # noqa: B905
        if x != y:
            break
        k += 1
    return k


def paths(words: list[str], first: list[int], number: int) -> list[list[int]]:
    """The nodes of each of sorted words, from depth 1. first: those already numbered of the first word; number: the next new one."""
    out, path, before = [], list(first), words[0][: len(first)] if words else ""
    for w in words:
        k = common(before, w)
        path = path[:k] + list(range(number, number + len(w) - k))
        number += len(w) - k
        out.append(path)
        before = w
    return out


def numbered(words: DataFrame, key: str, parts: int) -> DataFrame:
    """words with part, place (the order in the part) and path: the numbers of the trie nodes of column key, from depth 1. The root is 0.

    words must be distinct in key. Parts and places are in code-point order."""
    cut = stored(words.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "words")

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        w = sorted(group[key])
        own = paths(w, [], 1)
        nodes = len(w[0]) + sum(len(b) - common(a, b) for a, b in zip(w, w[1:], strict=False))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "first": [w[0]], "last": [w[-1]], "path": [own[-1]], "nodes": [nodes]})

    summary = cut.groupBy("part").applyInPandas(ends, "part int, first string, last string, path array<long>, nodes long").orderBy("part").collect()  # two words a part
    start, before, at, number = {}, "", [], 1
    for r in summary:
        k = common(before, r.first)
        shared = at[:k]
        start[r.part] = (shared, number)
        # In a part, the first word's node of depth d has local number d; of these the first k are shared.
        whole = shared + [number + d for d in range(len(r.first) - k)]
        inside = common(r.first, r.last)
        at = whole[:inside] + [number + x - k - 1 for x in r.path[inside:]]
        number += r.nodes - k
        before = r.last
    sent = words.sparkSession.sparkContext.broadcast(start)
    rest = [c for c in words.columns if c != key]

    def number_part(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(key, kind="stable").reset_index(drop=True)
        shared, first = sent.value[int(g["part"].iloc[0])]
        g["path"] = paths(list(g[key]), shared, first)
        g["place"] = range(len(g))
        return g[[key, *rest, "part", "place", "path"]]

    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    return cut.groupBy("part").applyInPandas(number_part, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *rest)) + ", part int, place long, path array<long>")


def neighbours(words: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(ids, near) of words (word, n), distinct. ids: id, word, n, id in code-point order of words. near: id, n_near, form_id, form_n
    for words with a neighbour at one inserted, deleted or replaced code point; the form is the one of largest n, then smallest id."""
    parts = max(1, -(-words.count() // part))
    forward = numbered(words.select("word", "n"), "word", parts)
    ids = stored(forward.select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("place")).alias("id"), "word", "n", F.col("path").alias("ahead")), "ids")
    back = numbered(ids.select(F.reverse("word").alias("drow"), "id"), "drow", parts).select("id", F.col("path").alias("back"))
    both = ids.join(back, "id").withColumn("length", F.length("word"))
    # Element i of pre and suf: the node of the prefix, of the suffix, of length i.
    both = both.select("id", "n", "word", "length", F.concat(F.array(F.lit(0).cast("long")), "ahead").alias("pre"), F.concat(F.array(F.lit(0).cast("long")), "back").alias("suf"))
    letters = F.split("word", "")

    def skipped(i):
        first = (i == 0) | (F.get(F.col("chars"), i) != F.get(F.col("chars"), i - 1))
        return F.struct(F.get("pre", i).alias("p"), F.get("suf", F.col("length") - 1 - i).alias("s"), F.when(first, 2).otherwise(1).alias("kind"))

    cut = lambda i: F.struct(F.get("pre", i).alias("p"), F.get("suf", F.col("length") - i).alias("s"), F.lit(0).alias("kind"))
    keys = both.withColumn("chars", letters).select("id", "n", F.inline(F.concat(F.transform(F.sequence(F.lit(0), F.col("length") - 1), skipped), F.transform(F.sequence(F.lit(0), F.col("length")), cut))))
    # At most one word a character of the alphabet, and one cut word.
    groups = keys.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "kind"))).alias("g")).where(F.size("g") > 1)

    def meets(x, y):
        return (y["id"] != x["id"]) & (((x["kind"] > 0) & (y["kind"] > 0)) | (x["kind"] + y["kind"] == 2))

    each = groups.select(F.inline(F.transform("g", lambda x: F.struct(x["id"].alias("id"), F.filter("g", lambda y: meets(x, y)).alias("by")))))
    each = each.where(F.size("by") > 0).select("id", F.size("by").cast("long").alias("k"), F.struct(F.get("by", F.lit(0))["m"].alias("m"), F.get("by", F.lit(0))["id"].alias("id")).alias("best"))
    near = each.groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return ids.drop("ahead"), stored(near.select("id", "n_near", F.col("best.id").alias("form_id"), (-F.col("best.m")).alias("form_n")), "near")


def roots(links: DataFrame, longest: int) -> DataFrame:
    """(id, root_id) of links (id, form_id), where chains have at most `longest` links: pointers double until they cover that."""
    now, reach = stored(links.select("id", F.col("form_id").alias("root_id")), "roots"), 1
    while reach < longest:
        ahead = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("beyond"))
        new = stored(now.join(ahead, "root_id", "left").select("id", F.coalesce("beyond", "root_id").alias("root_id")), "roots")
        dropped(now)
        now, reach = new, reach * 2
    return now


def variants(words: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), distinct and not null.

    form: the near word of largest n (then the smallest), if that n is at least ratio times the word's; root: the last form that forms
    lead to, the word itself if it has none. A form is at least ratio times as frequent, so chains are short and never turn back.
    An empty table gives no rows."""
    words = stored(words, "counted")
    ids, near = neighbours(words, part)
    links = stored(near.join(ids.select("id", "n"), "id").where(F.col("form_n") >= ratio * F.col("n")).select("id", "form_id"), "links")
    high, low = words.agg(F.max("n"), F.min("n")).first()
    steps, n = 0, max(low or 1, 1)
    while n * ratio <= (high or 0):
        n, steps = n * ratio, steps + 1
    root = roots(links, steps)
    named = lambda c: ids.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    formed = links.join(named("form"), "form_id").join(root, "id").join(named("root"), "root_id").select("id", "form", "root")
    out = ids.join(near.select("id", "n_near", "form_n"), "id", "left").join(formed, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))
