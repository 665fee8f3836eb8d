"""The operators' own logic against plain restatements, without Spark."""

import hashlib
import random
import re

import numpy as np
import pytest

from voxelbrick.llm import bpe, chat, decontam, minhash, pii, pq, quality, toxicity, warc
from voxelbrick.llm.common import env_path, shingle_hashes, word_hashes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_pii_equals_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(30_000):
        t = "".join(rng.choice("ab1.2@+-() 9%_5é") for _ in range(rng.randint(0, 40)))
        assert [s[:3] for s in pii.spans(t) if s[0] in pii.BASE] == base_spans(t)


def test_pii_checksums_context_and_redaction():
    card, iban = "4539 1488 0343 6467", "GB82 WEST 1234 5698 7654 32"
    assert pii.luhn(card.replace(" ", "")) and pii.mod97(iban) and not pii.mod97("GB83 WEST 1234 5698 7654 32")
    kinds = lambda t: [s[0] for s in pii.spans(t)]
    assert kinds(f"pay {card} or {iban}") == ["card", "iban"]
    assert kinds("my ssn is 078-05-1120") == ["ssn"] and kinds("part 078-05-1120") == []
    t = "write a.b@c.org now, from 10.0.0.1"
    assert pii.redacted(t, pii.spans(t)) == "write <EMAIL> now, from <IP>"
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 50_000):
        pii.spans(long)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = env_path("byte_bpe_50k.json")
    ours, theirs = bpe.Merger(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0, 0x250), 0x2028, 0x85, 0xA0, 0x3000, 0x661, 0x4E00, 0x1F600, 0x300]]
    texts = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 5000, " " * 3000 + "\n" * 3000, "don't  stop\r\n\t"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert [ours.count(t) for t in texts] == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_bpe_cache_is_bounded():
    m = bpe.Merger(env_path("byte_bpe_50k.json"))
    m.KEEP = 50
    words = [f"w{i}x{i * 7}" for i in range(500)]
    first = [m.count(w) for w in words]
    assert len(m.seen) <= 50 and len(m.older) <= 50 and [m.count(w) for w in words] == first


def distance(a, b):
    """Least edits of a to a substring of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance_and_pieces():
    rng = random.Random(2)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 90)))) for i in range(60)]
    m = decontam.Matcher(items, decontam.ERRORS)
    for i, (_, t) in enumerate(items):
        assert "".join(p for _, p in decontam.pieces(t)) == t and len(decontam.pieces(t)) <= decontam.budget(t) + 1
        w = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 120)))
        assert m.distance(i, w)[0] == distance(t, w)


def test_matcher_finds_what_brute_force_finds():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiouthrns") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 20)))) for i in range(12)]
    m = decontam.Matcher(items, decontam.ERRORS)
    for _ in range(60):
        i, t = rng.choice(items)
        q = list(t)
        for _ in range(rng.randint(0, 10)):
            p = rng.randrange(len(q))
            q[p : p + rng.randint(0, 1)] = rng.choice("xyz")
        doc = " ".join(word() for _ in range(15)) + " " + "".join(q) + " " + " ".join(word() for _ in range(15))
        got = {x[0]: x[1] for x in m.search(doc)}
        want = {k: d for k, s in items if (d := distance(s, doc)) <= decontam.budget(s)}
        assert got.keys() == want.keys()


def test_chat_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(5000):
        t = "".join(rng.choice("<|\\>end:\n ") for _ in range(rng.randint(0, 25)))
        stuffed = re.sub(r"<(\\*)\|", r"<\1\\|", t)
        assert "<|" not in stuffed and chat.parsed(f"<|turn:user|>\n{stuffed}<|end|>\n<|turn:|>\n<|end|>\n") == [("user", t), ("", "")]


def test_word_and_shingle_hashes():
    assert len(word_hashes(b"")) == len(word_hashes(b" \n\t\x0b\x0c\r ")) == 0
    a, b = word_hashes("Été The the ÉTÉ".encode()), word_hashes("Été the The".encode())
    assert a[1] == a[2] and a[0] == b[0] and a[0] != a[3]
    words = [f"w{i}" for i in range(20_000)]
    assert len(set(word_hashes(" ".join(words).encode()).tolist())) == 20_000
    assert len(shingle_hashes(b"one", 2)) == len(shingle_hashes(b"one two", 2)) == len(shingle_hashes(b"one two three", 5)) == 1
    assert len(shingle_hashes(b"a b a b a", 2)) == 2
    assert word_hashes(b"x\x1cy").size == 1  # only space and 9 to 13 part words


def test_hyperminhash_estimates():
    rng = np.random.default_rng(0)
    errors = []
    for j in (0.2, 0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = 600
        same = int(round(2 * n * j / (1 + j)))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:same], pool[n : 2 * n - same]]))
        got = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([n]), np.array([n]))[0]
        errors.append(abs(got - j))
    assert max(errors) < 0.1
    assert (minhash.registers(np.zeros(0, np.uint64)) == 255).all() and (minhash.band_keys(minhash.registers(np.zeros(0, np.uint64))) == 0).all()


def test_trees_and_statistics():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert ((m.scores(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.97
    assert quality.fit(np.zeros((0, 6)), np.zeros(0)).scores(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x, np.ones(3000)).scores(x[:5]) > 0.9).all()
    for t in (b"", b" ", b"\n", b"word", b"x" * 200_000):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and np.isfinite(s).all()


def test_field_marginals_equal_enumeration():
    f = toxicity.Field({}, np.array([[0.3, -1.0], [0.2, 0.5]]), np.array([0.1, -0.4]))
    s, first = np.array([0.5, -1.0, 2.0, 0.1, -0.3]), np.array([True, False, False, True, False])
    p = f.marginals(s, first)[0]
    for at, n in ((0, 3), (3, 2)):
        total, hit = 0.0, np.zeros(n)
        for states in np.ndindex(*(2,) * n):
            e = f.start[states[0]] + sum(s[at + i] * k for i, k in enumerate(states)) + sum(f.trans[a, b] for a, b in zip(states, states[1:], strict=False))
            total += np.exp(e)
            hit += np.exp(e) * np.array(states)
        assert np.allclose(p[at : at + n], hit / total)
    rng = np.random.default_rng(2)
    s, first = rng.normal(size=1000), rng.random(1000) < 0.05
    first[0] = True
    whole, cuts = f.marginals(s, first)[0], [*np.flatnonzero(first), 1000]
    parts = np.concatenate([f.marginals(s[a:b], first[a:b])[0] for a, b in zip(cuts, cuts[1:], strict=False)])
    assert np.allclose(whole, parts)


def test_toxic_words_and_spans():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ter", "un"]) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    toxic = [" ".join(word() for _ in range(30)) + f" zorg{word()} " + " ".join(word() for _ in range(30)) for _ in range(200)]
    f = toxicity.fit(toxic[:150], clean[:200])
    p, spans = toxicity.marked([*toxic[150:], *clean[200:], None, "", "123 !"], f)
    assert (p[:50] >= 0.5).all() and (p[50:] < 0.5).all() and p[-3:].tolist() == [0, 0, 0]
    assert all(any(toxic[150 + i][a:b].startswith("zorg") for a, b, _ in spans[i]) for i in range(50))
    assert toxicity.fit([], clean).weights[""] < -5


@pytest.mark.parametrize("dictionary", [True, False])
def test_warc_records(dictionary):
    import zstandard

    pages = [(i, f"http://h/{i}\r\nx", (f"<p>page {i} " * 200).encode()) for i in range(30)]
    d = zstandard.train_dictionary(2000, [p for _, _, p in pages]).as_bytes() if dictionary else b""
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)
    frame = lambda i, u, p: press.compress(warc.record(i, u, p, hashlib.sha1(p).digest(), len(p), 3 if i == 5 else None))
    lead = warc.leading_frame(zstandard.ZstdCompressor().compress(d)) if d else b""
    whole = lead + b"".join(frame(*x) for x in pages)
    got = [r for _, r, problem in warc.records_of(whole) if problem is None]
    assert [(r["record_id"], r["payload"]) for r in got] == [(f"urn:page:{i}", None if i == 5 else p) for i, _, p in pages]
    assert got[5]["refers_to"] == "urn:page:3" and got[5]["payload_bytes"] == len(pages[5][2])
    cut = list(warc.records_of(whole[:-3]))
    assert cut[-1][2] and sum(x[2] is None for x in cut) == 29
    bad = press.compress(warc.record(1, "u", b"abc", hashlib.sha1(b"abd").digest(), 3, None))
    assert "digest" in next(iter(warc.records_of(lead + bad)))[2]
    assert list(warc.records_of(b"")) == [] and next(iter(warc.records_of(b"nonsense, not an archive")))[2]


FOREIGN = [
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\nsoftware: x\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: <http://a/>\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Target-URI: http://a/\r\n b\r\nContent-Type: application/http\r\nContent-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\nhi\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Block-Digest: md5:5d41402abc4b2a76b9719d911017c592\r\nContent-Type: text/dns\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Payload-Digest: blake9:zz\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:6>\r\nWARC-Refers-To: <urn:uuid:3>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:7>\r\nWARC-Block-Digest: sha1:aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa\r\nContent-Length: 2\r\n\r\nxx\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
]


def test_warc_of_other_writers():
    """Other ids, types, blocks and digests, without a dictionary; a skippable frame between records."""
    import struct

    import zstandard

    press = zstandard.ZstdCompressor()
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    got = list(warc.records_of(press.compress(FOREIGN[0]) + skip + b"".join(map(press.compress, FOREIGN[1:]))))
    good = [(r["record_id"], r["record_type"], r["payload"], r["url"], r["refers_to"]) for _, r, problem in got if problem is None]
    assert good == [
        ("urn:uuid:1", "warcinfo", b"software: x\r\n", None, None), ("urn:uuid:2", "request", b"", "http://a/", None), ("urn:uuid:3", "response", b"hi", "http://a/ b", None),
        ("urn:uuid:4", "response", b"hello", None, None), ("urn:uuid:5", "metadata", b"", None, None), ("urn:uuid:6", "revisit", None, None, "urn:uuid:3"),
    ]
    assert "digest" in got[6][2] and "warc-record-id" in got[7][2]
    bomb = press.compress(FOREIGN[3].replace(b"hello", b"0" * 10_000_000))
    assert "decodes to more" in list(warc.records_of(bomb, most=1_000_000))[0][2]


def test_warc_reading_is_linear():
    import time

    import zstandard

    rng = np.random.default_rng(0)
    pages = [rng.bytes(1500) for _ in range(8000)]
    press = zstandard.ZstdCompressor()
    frames = [press.compress(warc.record(i, "u", p, hashlib.sha1(p).digest(), len(p), None)) for i, p in enumerate(pages)]
    took = []
    for n in (2000, 8000):
        began = time.process_time()
        assert sum(problem is None for _, _, problem in warc.records_of(b"".join(frames[:n]))) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_trees_against_plain_code():
    """Scores by a walk for each row and tree; the first tree by trying every cut of every node."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 0] + rng.normal(scale=0.5, size=300) > 0).astype(float)
    m = quality.fit(x, y, trees=6, depth=3)
    for row, score in zip(x, m.scores(x), strict=True):
        total = m.start
        for t in range(6):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + (2 if row[m.feature[t, node]] > m.cut[t, node] else 1)
            total += m.value[t, node - m.feature.shape[1]]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda a: g[a].sum() ** 2 / (h[a].sum() + quality.L2)
    here = {0: np.ones(300, bool)}
    for node in range(7):
        a, best = here[node], 1e-6
        for f in range(4):
            for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
                low = a & (x[:, f] <= c)
                if min(h[low].sum(), h[a & ~low].sum()) >= quality.LEAST_HESSIAN:
                    best = max(best, gain(low) + gain(a & ~low) - gain(a))
        low = a & (x[:, m.feature[0, node]] <= m.cut[0, node])
        if best > 1e-6:
            assert np.isclose(gain(low) + gain(a & ~low) - gain(a), best)
        here[2 * node + 1], here[2 * node + 2] = low, a & ~low
    for leaf in range(8):
        a = here[7 + leaf]
        assert np.isclose(m.value[0, leaf], quality.RATE * g[a].sum() / (h[a].sum() + quality.L2))


def test_short_items_match_at_word_borders():
    m = decontam.Matcher([(1, "cat"), (2, "a b")], 0.08)
    assert m.search("concatenate the strings") == [] and m.search("x a by") == []
    assert m.search("the cat sat") == [(1, 0, 4, 7)] and m.search("cat") == [(1, 0, 0, 3)] and m.search("x a b") == [(2, 0, 2, 5)]


def test_pq_lookup_and_units():
    rng = np.random.default_rng(3)
    x = pq.units(rng.normal(size=(2000, 32)))
    ix = pq.Index(x, 2000, 0.37)
    own = ix.nearest(x)
    codes = ix.codes(x, own)
    c = int(np.bincount(own).argmax())
    k = np.flatnonzero(own == c)
    d = ix.lookup(x[:50], c, codes[k]).T
    true = ((x[:50, None] - x[k][None]) ** 2).sum(axis=2)
    assert np.abs(d - true).mean() < 0.2 and ix.probes(ix.far(x), own)[np.arange(2000), own].all()
    assert np.allclose(np.linalg.norm(pq.units([[1e300, 1e300], [1e-300, 0]]), axis=1), 1)
