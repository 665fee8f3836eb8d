"""Every operator on Spark: against brute force on small tables, and on odd ones (nulls, empty, long, repeated, clashing names)."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelbrick.llm import bpe, chat, decontam, minhash, mixing, pii, pq, quality, queries, toxicity, warc
from voxelbrick.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "word", "en", "a", 4), (5, "Mail a@b.org, call +1 (098) 555-0174.", "en", None, 10),
    (6, LONG, "en", "b", len(LONG)), (7, LONG, "en", "b", len(LONG)), (8, "same words in both of these texts here", "en", "b", 5), (8, "same words in both of these texts here", "en", "b", 5),
    (9, "Same WORDS in both of these texts here", None, "c", 5), (None, "a row without an id", "en", "c", 5), (10, "é" * 50 + "\u0000 \U0001f600", "fr", "", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "own") for r in ODD], DOCS + ", score string").withColumn("pii_spans", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (5, 0, 1), (6, 1, 0), (8, 0, 0), (8, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(got[n] == find(n) for e in edges if e[0] != e[1] for n in e)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii(odd, none):
    out = {r.doc_id: r for r in pii.find_pii(odd).where("doc_id <> 8").collect()}
    assert out[1].pii_redacted is None and out[1].pii_spans == [] and out[5].pii_redacted == "Mail <EMAIL>, call <PHONE>." and out[5].score == "own"
    d = {r.doc_id: r for r in pii.pii_digest(odd).collect()}
    assert d[1].base_sha256 == hashlib.sha256(b"").hexdigest() and d[5].spans == "email:5:12,phone:19:36" and (d[5].n_email, d[5].n_phone) == (1, 1)
    assert pii.find_pii(none).count() == 0 and len(pii.pii_digest(odd).collect()) == len(ODD)


def test_tokens(odd, none):
    from tokenizers import Tokenizer
    from voxelbrick.llm.common import env_path

    t = Tokenizer.from_file(env_path("byte_bpe_50k.json"))
    rows = bpe.count_tokens(odd.select("doc_id", "text")).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 512) for r in rows)
    assert bpe.count_tokens(none).count() == 0


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "Same words, in both of these texts"), (2, None), (3, ""), (None, "word"), (4, "ipsum dolor lorem IPSUM"), (4, "ipsum dolor lorem IPSUM")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()}
    assert got == {(8, 1), (9, 1), (6, 4), (7, 4)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench, block=10).collect()} == got
    left = decontam.clean(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 10]
    assert decontam.contaminated(odd, bench.where("false")).count() == 0 and decontam.clean(none, bench).count() == 0


def test_chat_chain(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi <|end|>"), (1, 1, "assistant", None), (1, 1, "assistant", "<\\|x"), (2, 0, None, "a|b%"), (3, 5, "we|rd<%>", "é"), (3, None, "assistant", ""), (-7, 0, "user", said), (-7, 1, "assistant", said), (4, 0, "user", LONG)]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, leaf int")
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_trees(chat.chain(df))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_chars == len(learnt) and got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.format_trees(chat.chain(df.where("false"))).count() == 0


def test_chat_without_conversation_id(spark):
    """Null conv_id is one conversation: its branches, ranks and digests come out like those of any other."""
    rows = [(c, *r) for c in (None, 5) for r in ((1, None, "user", "q", 0.0), (2, 1, "assistant", "bad", 0.1), (3, 1, "assistant", "good", 0.9), (4, 3, "user", "more", None))]
    tree = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = sorted((r.conv_id or 0, r.leaf, r.path_rank, [t for _, t in chat.parsed(r.formatted)]) for r in chat.format_trees(tree, keep=None).collect())
    assert got == [(c, *r) for c in (0, 5) for r in ((2, 2, ["q", "bad"]), (4, 1, ["q", "good", "more"]))]
    flat = spark.createDataFrame([(c, i, "assistant", f"t{i}") for c in (None, 5) for i in range(9)], "conv_id long, turn long, role string, text string")
    a, b = sorted((tuple(r) for r in chat.chat_digest(chat.format_trees(chat.chain(flat))).collect()), key=str)
    assert {a[0], b[0]} == {None, 5} and a[1:] == b[1:] and a[1] == 9


def test_chat_branches(spark):
    tree = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", None), (2, 7, 99, "user", "orphan", 1.0)], "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = [(r.conv_id, r.leaf, r.path_rank, [t for _, t in chat.parsed(r.formatted)]) for r in chat.format_trees(tree, keep=None).orderBy("conv_id", "path_rank").collect()]
    assert got == [(1, 4, 1, ["q", "good", "more"]), (1, 2, 2, ["q", "bad"]), (2, 7, 1, ["orphan"])]
    assert [r.leaf for r in chat.format_trees(tree).orderBy("conv_id").collect()] == [4, 7]


def test_chat_cycles(spark):
    """A cycle costs a row with a problem, not the job; other paths of the conversation stay."""
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, None), (1, 5, 4), (2, 1, 1), (None, 7, 8), (None, 8, 7), (3, 1, None)]
    tree = spark.createDataFrame([(c, n, p, "user", f"m{n}", 1.0) for c, n, p in rows], "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = chat.format_trees(tree, keep=None)
    assert sorted((r.conv_id, r.leaf) for r in got.where("problem is null").collect()) == [(1, 5), (3, 1)]
    assert sorted((r.conv_id or 0, r.problem.split()[0]) for r in got.where("formatted is null").collect()) == [(0, "2"), (1, "3"), (2, "1")]
    assert chat.chat_digest(got).count() == 2


def test_chat_bushy_tree_against_brute_force(spark):
    """Only the chosen leaves' paths are made, and they are the best ones."""
    rng = np.random.default_rng(6)
    rows, parent = [], {}
    for c in range(3):
        for n in range(300):
            parent[c, n] = None if n == 0 else int(rng.integers(max(0, n - 40), n))
            rows.append((c, n, parent[c, n], "assistant", f"{c}.{n}", float(np.round(rng.normal(), 3))))
    score = {(c, n): s for c, n, _, _, _, s in rows}

    def path(c, n):
        return ([] if parent[c, n] is None else path(c, parent[c, n])) + [n]

    tree = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = chat.format_trees(tree, keep=4).collect()
    for c in range(3):
        leaves = {n for n in range(300)} - {parent[c, n] for n in range(300)}
        want = sorted((-sum(score[c, i] for i in path(c, n)), n) for n in leaves)[:4]
        have = sorted((r.path_rank, r.leaf, r.path_score, r.formatted) for r in got if r.conv_id == c)
        assert [h[1] for h in have] == [n for _, n in want] and np.allclose([h[2] for h in have], [-s for s, _ in want])
        assert [[t for _, t in chat.parsed(h[3])] for h in have] == [[f"{c}.{i}" for i in path(c, n)] for _, n in want]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, list int")


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = [*(b for b in base for _ in range(3)), *(base[0] + rng.normal(scale=0.02, size=16) for _ in range(80)), *[base[1]] * 30]
    rows = [(i, [float(c) for c in np.float32(v + (rng.normal(scale=0.05, size=16) if i % 3 == 1 and i < 180 else 0))], i % 2, 0) for i, v in enumerate(x)]
    rows += [(1000, None, 1, 0), (1001, [0.0] * 16, 1, 0), (1002, [float("nan")] + [1.0] * 15, 1, 0), (1003, [None] + [1.0] * 15, 1, 0), (1004, rows[0][1], None, 0), (1005, [1.0] * 5, 1, 0), (1006, [], 1, 0), (1007, [float("inf")] + [1.0] * 15, 0, 0)]
    got = {r.vec_id: r for r in pq.near_vectors(_vectors(spark, rows)).collect()}
    v = np.array([r[1] for r in rows[: len(x)]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(near, False)
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= near.sum(1)).all() and have.sum() >= 0.9 * near.sum()
    label = np.arange(len(x))
    for _ in range(50):
        label = np.minimum(label, np.where(near, label[None], 10**9).min(1))
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1008))
    assert pq.near_vectors(_vectors(spark, rows[-8:-7])).count() == 1 and pq.near_vectors(_vectors(spark, [])).count() == 0


def _links(x):
    """(links of each vector, smallest vector reachable) by brute force."""
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = v @ v.T >= 0.93
    label = np.arange(len(v))
    while (low := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = low
    return near.sum(1) - 1, label


@pytest.mark.parametrize("rank", [3, 8, 64])
def test_vectors_near_a_subspace(spark, monkeypatch, rank):
    """200 lists in 64 dimensions, vectors near few of these: no link across lists is lost, and both ends count it."""
    monkeypatch.setattr(pq, "LIST_SIZE", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3200, rank)) @ rng.normal(size=(rank, 64)) + rng.normal(scale=0.02, size=(3200, 64))
    x[1600:2400] = x[:800] + rng.normal(scale=0.2, size=(800, 64))
    x = np.float32(x).astype(float)
    got = {r.vec_id: r for r in pq.near_vectors(_vectors(spark, [(i, v.tolist(), 1, 0) for i, v in enumerate(x)])).collect()}
    links, label = _links(x)
    assert links.sum() > 1000 and [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_vectors_of_odd_ids(spark):
    """Repeated vec_ids give a row each; a row without vec_id links with nothing."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 1, 0), (1, a, 1, 0), (2, a, 1, 0), (2, b, 1, 0), (None, a, 1, 0), (None, None, 1, 0), (5, b, None, 0), (6, [], 1, 0)]
    got = pq.near_vectors(_vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id != 2} == {(1, 2, 1, True), (None, 0, None, False), (5, 0, 5, True), (6, 0, 6, True)}
    assert pq.near_vectors(_vectors(spark, [(None, a, 1, 0), (3, None, 1, 0)])).count() == 2


def test_vectors_outside_the_sample(spark, monkeypatch):
    """Few vectors far from the many that the codebooks are fitted on link as they should."""
    monkeypatch.setattr(pq, "SAMPLE", 128)
    rng = np.random.default_rng(9)
    cone = rng.normal(size=64) + rng.normal(scale=0.05, size=(1500, 64))
    x = np.float32(np.concatenate([cone, np.repeat(rng.normal(size=(20, 64)), 3, axis=0) + rng.normal(scale=0.1, size=(60, 64))])).astype(float)
    got = {r.vec_id: r for r in pq.near_vectors(_vectors(spark, [(i, v.tolist(), 1, 0) for i, v in enumerate(x)])).collect()}
    links, label = _links(x)
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a", big, 1), (2, None, big, 1), (3, "u\r\nv", big, 1), (4, "", "small", 1), (5, "x", "small", 1), (6, "x", None, 1), (7, "x", "", 1), (8, "x", LONG, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = {r.page_id: r for r in warc.warc_digest(pages).collect()}
    assert len(got) == 8 and all(r.problem is None for r in got.values())
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in range(1, 6)] == [("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None)]
    back = {r.record_id: r for r in warc.read_archives(warc.write_archives(pages, 4000)).collect()}
    assert bytes(back["urn:page:3"].payload).decode() == big and bytes(back["urn:page:6"].payload) == b"" and back["urn:page:1"].payload is None
    odd = pages.where("page_id < 4").unionAll(pages.where("page_id = 3")).unionAll(pages.where("page_id < 3").withColumn("page_id", F.lit(None).cast("long")))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.problem or "") for r in warc.warc_digest(odd).collect())
    assert got == [(0, "response", 0, ""), (0, "response", 0, ""), (1, "revisit", 3, ""), (2, "revisit", 3, ""), (3, "response", 0, ""), (3, "response", 0, "")]
    assert warc.warc_digest(pages.where("false")).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * i) for i in range(1, 40)], "page_id long, url string, html string")
    made = warc.save_files(warc.write_archives(pages, 300), str(tmp_path)).collect()
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert len(made) > 1 and sorted(r.record_id for r in warc.read_archives(files).collect()) == sorted(f"urn:page:{i}" for i in range(1, 40))


def test_mixing(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == size and all(r.taken <= 2 * r.size for r in rows)
    per, most = defaultdict(lambda: [0, 0, 0.0]), defaultdict(int)
    for r in rows:
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        most[r.source] = max(most[r.source], r.size)
        assert r.taken == r.copies * r.size
    total, names = sum(p[0] for p in per.values()) * 1.5, sorted(per)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        level = (total - sum(2 * per[s][0] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 2 * per[s][0]}
        if not more:
            break
        capped |= more
    for s in names:
        assert math.isclose(per[s][2], 2 * per[s][0] if s in capped else weight[s] * level, rel_tol=1e-9)
        assert abs(per[s][1] - per[s][2]) <= most[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.taken == 0 for r in got if r.size == 0)
    took = mixing.mixture(odd)
    assert took.columns[: len(odd.columns)] == odd.columns and took.agg(F.sum("taken")).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0


def test_mixing_columns(spark, sf):
    assert mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    names = ["nth", "t_doc_id", "doc", "rank", "s", "_nth", "base"]
    docs = spark.createDataFrame([(i, "a b c", "x", *[777 + i] * len(names)) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    took = mixing.mixture(docs).collect()
    assert took and all(r[n] == 777 + r.doc_id for r in took for n in names)


def test_mixing_targets_of_many_sources(spark):
    """Levels by running sums against rounds of capping, with ties, empty sources and a null one."""
    rng = np.random.default_rng(3)
    sizes = [int(s) for s in rng.choice([0, 1, 5, 5, 100, 4000], 200)]
    rows = [(None if i == 7 else f"s{i:03d}", s, 1) for i, s in enumerate(sizes)]
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, units long").repartition(5)).collect()}
    order = sorted((n for n, _, _ in rows if n), key=str) + [None]
    size = {n: s for n, s, _ in rows}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(order)}
    assert {n: got[n]["rank"] for n in order} == {n: i for i, n in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes)
    while True:
        level = (total - sum(2 * size[n] for n in capped)) / sum(weight[n] for n in order if n not in capped)
        more = {n for n in order if n not in capped and weight[n] * level > 2 * size[n]}
        if not more:
            break
        capped |= more
    assert all(math.isclose(got[n].target, 2 * size[n] if n in capped else weight[n] * level, rel_tol=1e-9) for n in order)


def test_rounding_keeps_expectations(spark):
    """Over many seeds each document is taken about as often as its fraction says."""
    ids = spark.range(40).select(F.lit(0).alias("rank"), F.lit(40).alias("many"), F.struct(F.col("id").alias("doc_id"), (F.col("id") + 5).alias("size")).alias("id"), F.lit(0.3).alias("f"), (F.col("id") + 5).cast("double").alias("w"))
    taken = np.zeros(40)
    for seed in range(30):
        for r in mixing.rounded(ids, 40, seed * 10_000, 16).collect():
            taken[r.id.doc_id] += r.c
    assert abs(taken.mean() / 30 - 0.3) < 0.05


def brute_components(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*[w[j:] for j in range(k)], strict=False))
    ids = sorted(sets)
    part = {i: i for i in ids}
    place = {x: j for j, x in enumerate({x for s in sets.values() for x in s})}
    has = np.zeros((len(ids), len(place)), np.float32)
    for n, i in enumerate(ids):
        has[n, [place[x] for x in sets[i]]] = 1
    same, size = has @ has.T, has.sum(axis=1)
    links = [(ids[i], ids[j]) for i, j in np.argwhere(np.triu((same > 0) & (100 * same >= percent * (size[:, None] + size - same)), 1))]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(part[a], part[b])
            moved |= part[a] != m or part[b] != m
            part[a] = part[b] = m
    return part, sets


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, k).collect()}
    part, sets = brute_components([(r.doc_id, r.text) for r in docs.collect()], k, 80)
    assert {i: r.component_id for i, r in got.items()} == part and all(got[i].n_shingles == len(s) and got[i].kept == (part[i] == i) for i, s in sets.items())


def loose_group(rng, n, words, edits, other):
    """n copies of a text with 2 to edits words replaced, out of `other` ones, that links hang on pairs."""
    out = []
    for i in range(n):
        w = [f"w{j}" for j in range(words)]
        for p in rng.choice(words, rng.integers(2, edits + 1), replace=False):
            w[p] = f"v{rng.integers(other)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("merged, rows, shingles", [(4, 2048, 1 << 19), (0, 2048, 1 << 19), (4, 16, 1 << 19), (4, 2048, 500)])
def test_near_duplicates_of_a_loose_group(spark, monkeypatch, merged, rows, shingles):
    """Buckets as one unit and one by one; blocks cut by rows and by shingles."""
    monkeypatch.setattr(minhash, "MERGED", merged)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    docs = loose_group(np.random.default_rng(8), 60, 60, 3, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == brute_components(docs, 2, 80)[0]


def test_near_duplicates_of_a_large_loose_group(spark):
    """2,500 documents, most pairs at a similarity of 0.6 to 0.8, and repeated rows among them."""
    docs = loose_group(np.random.default_rng(9), 2500, 80, 5, 30)
    want = brute_components(docs, 2, 80)[0]
    assert 100 < len(set(want.values())) < 2400
    df = spark.createDataFrame(docs + docs[:50], "doc_id long, text string")
    got = minhash.near_duplicates(df, 2).collect()
    assert len(got) == 2550 and {r.doc_id: r.component_id for r in got} == want


def test_intersections(monkeypatch):
    monkeypatch.setattr(minhash, "AT_ONCE", 50)
    monkeypatch.setattr(minhash, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    sides = [[np.unique(np.concatenate([rng.integers(0, 40, rng.integers(0, 30)), rng.integers(0, 4000, 20)])).astype(np.uint64) for _ in range(n)] for n in (40, 25)]
    got = minhash.intersections(*[[x.tobytes() for x in s] for s in sides])
    assert got.tolist() == [[len(np.intersect1d(p, q)) for q in sides[1]] for p in sides[0]]


def test_near_duplicates_of_odd_rows(odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd, 2).collect()]
    assert len(got) == len(ODD)
    by = {g[0]: g for g in got}
    assert by[1][1:] == (0, 1, True) and by[7][2:] == (6, False) and by[9][2:] == (8, False) and by[4][1:] == (1, 4, True) and by[None][3] is False
    assert minhash.near_duplicates(none, 2).count() == 0


def test_quality(spark, sf, odd, none, labels):
    docs, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    right = [rows[r.doc_id].predicted == r.quality for r in y.collect() if rows[r.doc_id].held_out]
    assert np.mean(right) > 0.85
    m = quality.train(odd, labels)
    out = quality.score(odd, m, keep_columns=True)
    assert out.count() == len(ODD) and out.columns.count("score") == 1
    empty = quality.train(none, labels)
    assert quality.score(none, empty).count() == 0 and quality.score(odd, quality.train(odd, labels.where("false"))).count() == len(ODD)


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    y = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in y]) > 0.95


def test_repeated_documents_do_not_grow_the_sample(spark, labels, monkeypatch):
    rows = [(i, f"text {i} {k}") for i in (1, 5, 6, 8) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)))
    quality.train(docs, labels)
    monkeypatch.setattr(toxicity, "fit", lambda a, b: seen.append(len(a) + len(b)))
    toxicity.train(docs, labels)
    assert max(seen) <= 4


def test_toxicity(spark, sf, odd, none, labels):
    m = toxicity.train(odd, labels)
    assert toxicity.tag(odd, m).count() == len(ODD) and toxicity.tag(none, m).count() == 0
    assert toxicity.train(none, labels).weights[""] < 0
    big = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op10_toxicity(spark, big).collect()}
    y = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.toxic for r in y]) > 0.93
    assert np.mean([rows[r.doc_id].predicted for r in y if not r.toxic]) < 0.05


def test_sql_answers(spark, sf, duck):
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        cur = duck.execute(sql)
        columns = [d[0] for d in cur.description]
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(map(key, cur.fetchall())) == sorted(key([r[c] for c in columns]) for r in got.collect())


def test_pipeline_stages(spark, sf, odd, none):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    numbers = []
    for _, stage in P.STAGES:
        before, docs = docs.count(), stage(spark, docs, sf)
        assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        numbers.append((before, docs.count()))
    assert numbers[0][1] < numbers[0][0] and numbers[3][0] == numbers[3][1]
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0
        plain = odd.drop("score", "pii_spans")
        assert stage(spark, plain, sf).count() <= len(ODD)


def test_near_dedup_of_repeated_ids(spark, sf):
    """Of rows with one doc_id the one with the first text stays, whatever the partitions."""
    import corpus_pipeline as P

    rows = [(1, f"some text number {i} of many words", "en", f"s{i}", i) for i in (3, 1, 2)] + [(1, None, "en", "s9", 9), (2, "other", "en", "a", 1), (2, "other", "en", "b", 1), (None, "x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = [sorted(map(str, P.near_dedup(spark, docs.repartition(n), sf).collect())) for n in (1, 3, 5)]
    assert len(got[0]) == 3 and got[0] == got[1] == got[2]
