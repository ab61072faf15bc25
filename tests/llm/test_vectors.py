import math

import numpy as np

from lattice.llm import vectors as V


def brute(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and all(math.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(good):
        for j, b in good[:x]:
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: (links[i], root(i), root(i) == i) for i in links}


def make(n_groups=30, seed=2):
    rng, rows, n = np.random.default_rng(seed), [], 0
    for _ in range(n_groups):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append((n := n + 1, [float(x) for x in base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2])]))
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()} == brute(rows)


def test_groups_and_odd_vectors(spark):
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0] * 3), (907, [2.0] * 3), (-1, [2.0] * 16), (908, [1.0] * 16)]
    check(spark, make() + odd)


def test_a_bucket_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    check(spark, [(i, [float(x) for x in base + 0.08 * rng.standard_normal(16)]) for i in range(100)] + [(200 + i, [float(x) for x in base]) for i in range(20)])


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, 6), (2, [1.0, 2.0], 5, 6), (None, [1.0, 2.0], 5, 6)], "vec_id long, embedding array<float>, rep int, codes int")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)}
    assert V.near_duplicates(df.limit(0)).count() == 0


def test_components_of_any_size(spark):
    base = [[x * s for x in v] for s in (1e200, 1e-200, 5e-324 * 2**20, 1.0) for v in ([1.0, 2.0, 3.0], [3.0, -1.0, 0.5])]
    rows = list(enumerate(base))
    scaled = [(i, [x / max(map(abs, v)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()} == brute(scaled)


def test_small_groups_and_large_ones_agree():
    rng = np.random.default_rng(3)
    rows = V.unit(np.repeat(rng.standard_normal((40, 8)), 3, axis=0) + 0.1 * rng.standard_normal((120, 8)))
    ends = np.array([2, 10, 26, 60, 62, 120])
    starts = np.concatenate([[0], ends[:-1]])
    side = np.zeros(120, int)
    side[26:60] = rng.integers(0, 2, 34)
    code = rng.integers(0, 4, (120, 2))
    a, b, first = V._links(rows, code, side, starts, ends, 0.9)
    want = set()
    for s, e in zip(starts, ends):
        for i in range(s, e):
            for j in range(i + 1, e):
                if rows[i] @ rows[j] >= 0.9 and (not side[s:e].any() or side[i] != side[j]):
                    want.add((i, j, not (code[i] == code[j]).any()))
    assert set(zip(a.tolist(), b.tolist(), first.tolist())) == want and len(a) == len(want)


def test_recall_at_the_threshold_does_not_depend_on_the_number_of_vectors():
    rng = np.random.default_rng(4)
    a = V.unit(rng.standard_normal((2000, 32)))
    o = rng.standard_normal((2000, 32))
    o -= (o * a).sum(axis=1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * V.unit(o)
    for n in (100, 50_000, 10**9):
        tables, bits = V.scheme(n, 0.95)
        few = min(tables, 60)  # the chance per table, from fewer of them
        share = (V.codes(a, few, bits) == V.codes(b, few, bits)).mean()
        assert (1 - share) ** tables < 1e-4
    assert V.scheme(50_000, 0.95) == (101, 20) and V.scheme(50_000 << 20, 0.95)[0] < 1000
