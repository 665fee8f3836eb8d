"""Spelling variants, risk-controlled rules and hard negatives against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbrick.llm import negatives, queries, rules, variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(variants._UPPER, variants._LOWER)
DOCS = "doc_id long, text string, lang string"

# ---------------------------------------------------------------- spelling variants


def counts(rows, drop_every=31):
    out = collections.Counter()
    for doc_id, text in rows:
        for w in LETTERS.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(n, ratio=10):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: (lambda b: b if b and n[b] >= ratio * n[w] else None)(min(o, key=lambda x: (-n[x], x), default=None)) for w, o in near.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_of_documents(spark, sf):
    got = queries.op11_spelling_variants(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = counts(docs)
    assert {r.word: r.n for r in got} == n
    some = {w: k for w, k in n.items() if w[0] in "aeq"}  # brute force is quadratic; a neighbour may differ in its first letter, so these words alone are asked
    table = spark.createDataFrame(list(some.items()), "word string, n long")
    assert {tuple(r) for r in variants.variants(table, ratio=2, part=20).collect()} == brute_variants(some, 2)


def test_variants_in_many_parts(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), size=k)) for k in rng.integers(7, 11, 500)} | {"a" * 7, "a" * 8, "a" * 9, "ab" * 5000}
    table = [(w, int(rng.choice([2, 3, 30, 400, 5000]))) for w in sorted(words)]
    df = spark.createDataFrame(table, "word string, n long")
    for part in (37, 1000):
        assert {tuple(r) for r in variants.variants(df, part=part).collect()} == brute_variants(dict(table))


def test_node_numbers(spark):
    words = ["abc", "abd", "b", "ba", "baa", "bab", "c"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for parts in (1, 3, 7):
        at = {r.word: [0, *r.path] for r in variants.numbered(df, "word", parts).collect()}
        node = collections.defaultdict(set)
        for w in words:
            for d in range(len(w) + 1):
                node[w[:d]].add(at[w][d])
        assert all(len(x) == 1 for x in node.values())
        assert len({next(iter(x)) for x in node.values()}) == len(node)


def test_words_of_odd_rows(spark):
    rows = [(1, "Wordword WORDWORD wordwordÉ"), (1, "Wordword WORDWORD wordwordÉ"), (None, "Wordword wordword"), (2, None), (3, ""), (4, "x" * 30_000 + "9" + "x" * 30_000)]
    df = spark.createDataFrame([(*r, "en") for r in rows], DOCS)
    got = {r.word: r.n for r in variants.counted(df.withColumnsRenamed({"lang": "word"})).collect()}
    assert got == counts(rows)
    assert variants.variants(variants.counted(df.where("false"))).collect() == []


# ---------------------------------------------------------------- quality rules


def plain_counts(text):
    w = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    repeat = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def test_base_counts(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op12_quality_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        want, r = plain_counts(text), got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_base_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx", "a\rb\x0bc\x0cd\x1ce f #<|>", "é 😀 é 😀 é 😀", "ab " * 30_000, "\n".join(["l"] * 5)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(None, "a b c d", "en"), (3, "a", None)], DOCS).withColumn("words", F.lit(1)).withColumn("cuts", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = rules.judge(df, labels).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
    assert rules.judge(df.where("false"), labels).collect() == []
    assert rules.judge(df, labels.where("false")).where("not base_failed and not kept").collect() == []


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 10), (3, 200), (5, 1000), (19, 1000), (30, 1000), (0, 0), (150, 10_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.withColumn("p", rules.tail(F.col("k"), F.col("n"), 0.02)).collect():
        exact = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.02) + (r.n - i) * math.log(0.98)) for i in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k > 0.02 * r.n else exact, rel=1e-9)


def planted(spark, good, bad, noisy):
    """Texts of 60 words; bad ones have 30 symbols, the first `noisy` good ones as well. Stratum b has 20 texts only."""
    plain = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, plain(i) + (" # " * 30 if i < noisy else ""), "a", 1) for i in range(good)] + [(10_000 + i, plain(i) + " # " * 30, "a", 0) for i in range(bad)]
    rows += [(20_000 + i, plain(i) + (" # " * 30 if i % 2 else ""), "b", i % 2 ^ 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_cutoffs_are_risk_controlled(spark):
    docs, labels = planted(spark, 1500, 200, 0)
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert all(got[i].kept for i in range(1500)) and not any(got[10_000 + i].kept for i in range(200))
    assert {got[10_000].rule} == {"symbols"}
    assert all(got[20_000 + i].kept for i in range(20))  # too few labels for a bound
    # A tenth of the good texts look like the bad ones: no cutoff that rejects these is allowed.
    docs, labels = planted(spark, 1500, 200, 150)
    assert all(r.kept for r in rules.judge(docs, labels).collect())


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, every=50, positives=5, most=3):
    """rows: distinct (vec_id, label, tuple of ints)."""
    out = set()
    for a, la, qa in rows:
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(qa, q, strict=True)), b, lb == la) for b, lb, q in rows if b != a and len(q) == len(qa))
        for m, p, _ in [x for x in s if x[2]][:positives]:
            fit = [x for x in s if not x[2] and 50 * -m <= 100 * -x[0] <= 95 * -m][:most]
            out |= {(a, p, k + 1, n, -m, -t) for k, (t, n, _) in enumerate(fit)}
    return out


def test_negatives_with_copies_ties_and_lengths(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 6))
    rows = [(i, int(rng.integers(3)), [float(x) for x in (base[i % 40] + 0.3 * rng.normal(size=6) if i % 3 else base[0])]) for i in range(600)]
    rows += [(600 + i, i % 2, [1.0, float(i)]) for i in range(60)] + [(700, 0, []), (750, 0, [0.0] * 6), (800, 1, [-1.0] * 6), (850, 1, [1e300] * 6)]
    odd = [(None, 0, [1.0] * 6), (900, None, [1.0] * 6), (950, 1, None), (1000, 1, [1.0, None]), (1050, 1, [float("nan")] * 6), (1100, 2, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + odd + rows[:50], "vec_id long, label int, embedding array<double>").withColumn("q", F.lit("clash"))
    q = negatives.quantised(df)
    have = [(r.vec_id, r.label, tuple(r.q)) for r in q.collect()]
    assert {(a, b) for a, b, _ in have} == {(a, b) for a, b, _ in rows if a != 850}
    assert all(v == tuple(math.floor(256 * x) for x in rows[a][2]) for a, _, v in have if a < 600)
    want = brute_negatives(have)
    assert len(want) > 50
    for sample, block in ((2048, 4096), (20, 64), (0, 100)):
        got = negatives.hard_negatives(q, F.col("vec_id") % 50 == 0, sample=sample, block=block)
        assert {tuple(r) for r in got.collect()} == want
    assert negatives.hard_negatives(q.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_survivors(spark):
    rng = np.random.default_rng(3)
    a, y = rng.integers(-40, 60, (30, 37)), rng.integers(-40, 60, (200, 37))
    y[::5] //= 8  # short vectors, which the index omits
    s = a @ y.T
    for least in (np.full(30, -1e18), np.zeros(30), np.quantile(s, 0.99, axis=1), np.full(30, s.max() + 1.0), np.linspace(0, s.max(), 30)):
        i, j, score = negatives.survivors(a, y, np.ceil(least))
        want = {(int(p), int(q)) for p, q in zip(*np.nonzero(s >= least[:, None]), strict=True)}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and (score == s[i, j]).all()


def test_negatives_against_sql(spark, sf, duck):
    cur = duck.execute(queries.SQL["op13_hard_negatives"])
    names = [d[0] for d in cur.description]
    assert {tuple(r[c] for c in names) for r in queries.op13_hard_negatives(spark, sf).collect()} == set(cur.fetchall())


def test_rules_against_sql(spark, sf, duck):
    cur = duck.execute(queries.SQL["op12_quality_rules"])
    names = [d[0] for d in cur.description]
    assert {tuple(r[c] for c in names) for r in queries.op12_quality_rules(spark, sf).collect()} == set(cur.fetchall())
