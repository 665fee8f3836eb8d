"""Cases that earlier versions cut, capped or sent to one task."""

import numpy as np
from pyspark.sql import functions as F

from voxelbrick.llm import decontam, pq, toxicity, warc


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 0, [1.0, 0.0, 0.0]), (2, 0, [0.0, 1.0, 0.0]), (3, 0, [0.0, 0.0, 1.0]), (4, 0, [1.0, 2.0]), (5, 0, [1.0, 2.0]), (6, 0, [1.0, 2.0, 0.0]), (7, 1, [1.0]), (8, 1, [3.0]), (9, 1, [-1.0]), (10, 1, [1.0] * 9), (11, 1, [1.0] * 12)]
    rows += [(100 + i, int(rng.integers(2)), [float(x) for x in rng.normal(size=rng.integers(1, 10))]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    links = {i: [j for j, m, w in rows if j != i and m == k and len(w) == len(v) and unit[i] @ unit[j] >= 0.93] for i, k, v in rows}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in links.items()}
    assert got[4][0] >= 1 and got[5][1] == 4
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert got[i][1] == min(seen)


def test_rows_without_page_id_are_spread(spark):
    rows = [(i, f"u{i}", f"<p>{i}</p>" * 300) for i in range(400)] + [(None, f"n{i}", f"<q>{i}</q>" * 300) for i in range(400)] + [(7, f"r{i}", f"<r>{i}</r>" * 300) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.write_archives(pages, archive_bytes=60_000)
    per = [r["count"] for r in warc.read_archives(made).where("problem is null").groupBy("path").count().collect()]
    assert sum(per) == 1000 and len(per) > 30 and max(per) < 3 * sum(per) / len(per)


def test_a_frame_that_is_too_large_is_passed_over(spark):
    rows = [(i, "u", "x" * (50_000 if i == 3 else 20)) for i in range(30)]
    made = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), archive_bytes=1 << 30)
    got = warc.read_archives(made, most=5_000).collect()
    assert len(got) == 30 and sum(r.problem is not None for r in got) == 1
    assert all(r.problem is None for r in warc.read_archives(made).collect())


def test_where_passages_begin():
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    m = decontam.Matcher([(1, item)], 0.1)
    for cut in ("quick", "today", "the quick", "lazy "):
        text = "some words before it " + item.replace(cut, cut[: len(cut) // 2], 1) + " and some after"
        text = decontam.normalised(text)
        ((_, d, start, end),) = m.search(text)
        want = min(range(start - 3, end), key=lambda k: (edits(item, text[k:end]), end - k))
        assert edits(item, text[start:end]) == d and start == want
    missing = decontam.normalised("0123456789 abcd " + item[4:])
    ((_, d, start, _),) = m.search(missing)
    assert d == edits(item, missing[start:]) and start >= 15


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_long_texts_train_the_field(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abdefgiklmnoprstu"), size=rng.integers(2, 9))) for _ in range(3000)]
    said = lambda n: " ".join(rng.choice(words, size=n))
    rows = [(i, said(4000)) for i in range(60)] + [(1000 + i, said(5000) + " vexgrub vexgrubbed " + said(200)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.tag(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[1000 + i] for i in range(20)) and not any(got[i] for i in range(60))
