import random

import numpy as np

from lattice.llm import setsketch as S


def words_of(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def brute(rows, percent=75):
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_planted_groups_chains_and_odd_texts(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 30, 120, 300]))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((n := n + 1, " ".join(copy)))
            base = copy if rnd.random() < 0.5 else base  # chains: ends may be unlike
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one\x0btwo"), (1005, "É a"), (1006, "é a"), (1007, "x" * 100_000), (1008, "x" * 100_000), (-5, rows[0][1].upper())]
    check(spark, rows)


def test_a_group_of_near_copies_around_one_text(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rnd.randint(0, 9)):
            copy[rnd.randrange(200)] = f"e{rnd.random()}"
        rows.append((i, " ".join(copy)))
    check(spark, rows)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        found = []
        for _ in range(40):
            both, one, two = (rng.integers(0, 2**64, int(x), dtype=np.uint64) for x in (2000 * share, 1000 * (1 - share), 1000 * (1 - share)))
            a, b = (np.unique(np.concatenate([both, x])) for x in (one, two))
            ra, rb = S.registers(a), S.registers(b)
            found.append(S.estimated(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0])
        true = len(both) / (len(both) + len(one) + len(two))
        assert abs(np.mean(found) - true) < 0.03
        assert (S.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()  # sketches merge


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (None, "a b c d e f", 3, "z")], "doc_id long, text string, n_shingles int, rep string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in S.near_duplicates(df).collect())
    assert got == [(-1, 2, None, True), (1, 2, 1, True), (1, 2, 1, True)]
    assert S.near_duplicates(df.limit(0)).count() == 0
