import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

from lattice.llm import periods as P
from lattice.llm.queries import period_digest, op12_periodic_runs, with_periods


def brute(w, least=P.LEAST, times=P.TIMES):
    """Runs by comparing each word with the one q places on, for each q."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                out.setdefault((s, i + q), q)  # a shorter period of the same stretch came before
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def odd_words(rnd):
    w, k = [], rnd.choice([1, 2, 2, 3, 5])
    while len(w) < rnd.choice([0, 1, 2, 5, 20, 40, 90]):
        w += [rnd.randrange(k)] if rnd.random() < 0.3 else [rnd.randrange(k) for _ in range(rnd.randint(1, 6))] * rnd.randint(1, 8)
    return [b"%d" % x for x in w]


def test_equals_brute_force():
    rnd = random.Random(5)
    for _ in range(600):
        docs = [odd_words(rnd) for _ in range(rnd.randint(1, 6))]
        least, times = rnd.choice([(24, 3), (1, 2), (4, 2), (6, 3), (10, 4)])
        for d, g in zip(docs, P.runs_of(docs, least, times)):
            assert [tuple(map(int, r)) for r in g] == brute(d, least, times)
            assert P.collapsed(d, g) == b" ".join(kept(d, brute(d, least, times)))


def test_small_blocks_of_candidates(monkeypatch):
    monkeypatch.setattr(P, "CANDIDATES", 7)
    rnd = random.Random(6)
    for _ in range(100):
        docs = [odd_words(rnd) for _ in range(3)]
        assert [[tuple(map(int, r)) for r in g] for g in P.runs_of(docs, 6, 2)] == [brute(d, 6, 2) for d in docs]


def test_grammar_answers():
    rnd = random.Random(7)
    for _ in range(60):
        import numpy as np

        w = [rnd.randrange(2) for _ in range(rnd.randint(2, 200))]
        sym = np.array([*w, 2])
        g = P.Grammar(sym, 2, 3)
        x = np.array([rnd.randrange(len(w)) for _ in range(50)])
        y = np.array([rnd.randrange(i + 1, len(w) + 1) for i in x])
        ahead, behind = g.ahead(x, y), g.behind(x, y)
        for a, b, f, r in zip(x, y, ahead, behind):
            n = 0
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            assert f == n
            n = 0
            while n < a and w[a - 1 - n] == w[b - 1 - n]:
                n += 1
            assert r == n


def test_long_texts_take_no_square():
    began = time.process_time()
    a, b = "a", "ab"
    while len(b) < 150_000:
        a, b = b, b + a
    found = P.runs_of([[b"a"] * 300_000, [b"a", b"b"] * 100_000, [c.encode() for c in b], [b"%d" % i for i in range(200_000)]])
    assert [tuple(map(int, r)) for f in found[:2] for r in f] == [(0, 300_000, 1), (0, 200_000, 2)] and len(found[3]) == 0
    assert time.process_time() - began < 30


def edit(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(doc_id, text):
    w = edit(doc_id, text)
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept(w, runs))))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())


def test_odd_rows(spark):
    text = " ".join(["a b c"] * 30)
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \t\n "), (5, "one"), (6, "  \x1c x  " * 30), (7, "é " * 40 + "b " * 30 + "é"), (8, "x" * 1_000_000), (9, "ab " * 200_000), (23, "w " * 50), (33, "k l")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, best string, runs int")
    small = [r for r in rows if r[0] != 9]
    got = rows_of(period_digest(with_periods(df)))
    assert [r for r in got if r[0] != 9] == sorted(digest(*r) for r in small)
    assert next(r for r in got if r[0] == 9)[1:5] == (1, 0, 200_000, 1)
    out = P.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "best", "n_words", "runs", "collapsed"] and out.count() == len(rows)
    assert P.periodic_runs(df.limit(0)).collect() == []


def test_edit_of_a_tenth_of_the_ids(spark):
    text = " ".join(f"w{i}" for i in range(300))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0] + [1, 2]
    df = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    assert rows_of(period_digest(with_periods(df))) == sorted(digest(i, text) for i in ids)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 3000}
    got = rows_of(op12_periodic_runs(spark, sf))
    assert len(got) == len(docs) and len(short) > 150
    assert [r for r in got if r[0] in short] == sorted(digest(i, t) for i, t in short.items())
