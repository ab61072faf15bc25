import numpy as np
from pyspark.sql import functions as F

from lattice.llm import mixing as X
from lattice.llm.queries import SHARES, domain_labels, op1_mixing


def test_totals_meet_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = op1_mixing(spark, sf).collect()
    assert len(rows) == 1000 and all(r.rate >= 0 for r in rows)
    p = np.array([[r.p_high, r.p_low, r.p_toxic] for r in rows])
    assert np.allclose(p.sum(1), 1)
    total = (np.array([r.rate * r.n_tokens for r in rows])[:, None] * p).sum(0)
    a = np.array([r.n_tokens for r in rows])[:, None] * p
    first, goal = a.sum(0), np.array(list(SHARES.values())) * a.sum()
    r = np.ones(len(a))
    for _ in range(3000):
        r = np.maximum(0, r - p @ ((a.T @ r - goal) / first))
    assert np.allclose(total, a.T @ r, rtol=0.02)
    gap = lambda t: np.sum((t - goal) ** 2 / first)
    assert gap(total) < 0.5 * gap(first)
    truth = {r.doc_id: r.domain for r in domain_labels(spark, sf).collect()}
    said = {r.doc_id: list(SHARES)[int(np.argmax(q))] for r, q in zip(rows, p)}
    assert sum(said[d] == t for d, t in truth.items()) / len(truth) > 0.85


def test_rates_against_a_dense_solver(spark):
    rng = np.random.default_rng(0)
    n, p, shares = rng.integers(1, 500, 300), rng.dirichlet([0.4, 0.3, 0.2], 300), [0.3, 0.3, 0.4]
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    got = X.fit_rates(df, shares).collect()
    a = np.array([r.n_tokens for r in got])[:, None] * np.array([r.p for r in got])
    first = a.sum(0)
    goal = np.array(shares) * first.sum()
    r = np.ones(len(a))
    for _ in range(5000):
        r = np.maximum(0, r - (a / a.sum(1, keepdims=True)) @ ((a.T @ r - goal) / first))
    assert np.allclose(a.T @ r, goal, rtol=1e-3)
    assert np.allclose([x.rate for x in got], r, atol=0.02)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "good words here", 1), (3, "good words here", 1), (None, "bad stuff", 1)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(3, "high"), (None, "low"), (1, None), (9, "zzz")], "doc_id long, domain string")
    rows = X.mix(docs, labels, {"high": 1.0, "low": 1.0}).collect()
    assert len(rows) == 5 and all(r.rate >= 0 for r in rows)
    assert X.mix(docs, labels.limit(0), {"high": 1.0, "low": 1.0}).count() == 5
    assert X.mix(docs.limit(0), labels, {"high": 1.0, "low": 1.0}).count() == 0
    one = spark.range(1).select(X.copies(F.lit(2.0), F.lit(1)), X.copies(F.lit(0.0), F.lit(1))).first()
    assert tuple(one) == (2, 0)
