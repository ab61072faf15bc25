"""Owners and enclosing methods (L1, L2) against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lattice.operators import linking

DECL = "repo string, commit_sha string, path string, ord long, name string, kind string, start long, end long"


def _decls(seed: int, n: int, reach: int) -> list:
    rng, rows = random.Random(seed), []
    for i in range(n):
        start = rng.randrange(reach)
        end = start + rng.choice((0, 1, rng.randrange(5), rng.randrange(reach)))
        rows.append((f"r{i % 2}", "c", rng.choice(("a", "b")), i, f"N{i % 11}", rng.choice(("Class", "Method", "Interface")), start, end))
    return [*rows, *[(r, c, p, o + n, m, k, s, e) for r, c, p, o, m, k, s, e in rows[:5]]]


@pytest.mark.parametrize("direct", [64, 2, 0])
def test_owner_and_call_equal_brute_force(spark, monkeypatch, direct):
    """Some spans are the same, some empty, some cross; files lie on both sides of the bound, or all beyond it."""
    monkeypatch.setattr(linking, "DIRECT", direct)
    monkeypatch.setattr(linking, "SLICES", 4)
    rows = [*_decls(direct, 120, 40), *_decls(direct + 1, 9, 1 << 40), ("r0", "c", "a", 900, "X", "Class", None, 5), ("r0", "c", "a", 901, "Y", "Method", 3, None), ("r0", "c", "solo", 902, "Z", "Method", 1, 2), ("r0", "c", None, 903, "Q", "Method", 1, 2)]
    inside = lambda a, b: a[:3] == b[:3] and None not in (a[2], a[6], a[7], b[6], b[7]) and b[6] <= a[6] and b[7] >= a[7]
    owners, calls = {}, {}
    for a in (r for r in rows if r[5] == "Method"):
        around = [b for b in rows if b[5] != "Method" and inside(a, b)]
        owners[a[0], a[2], a[3]] = min(around, key=lambda b: (b[7] - b[6], b[3]))[4] if around else None
    for a in (r for r in rows if r[5] == "Interface"):
        around = [b[3] for b in rows if b[5] == "Method" and inside(a, b)]
        if around:
            calls[a[0], a[2], a[3]] = min(around)
    # ord names a row of a file only if it is unique there
    assert len({(r[0], r[2], r[3], r[4]) for r in rows}) >= len(rows) - 9
    decls = spark.createDataFrame(rows, DECL)
    found = linking.assign_owner(decls)[0].filter("kind = 'Method'").collect()
    one = {(r.repo, r.path, r.ord) for r in found if sum((q.repo, q.path, q.ord) == (r.repo, r.path, r.ord) for q in found) == 1}
    assert {k: v for k, v in ((((r.repo, r.path, r.ord)), r.owner) for r in found) if k in one} == {k: v for k, v in owners.items() if k in one} and len(one) > 30
    asked = decls.filter("kind = 'Interface'").withColumnRenamed("ord", "call")
    asked_once = {k: v for k, v in calls.items() if sum((r[0], r[2], r[3]) == k for r in rows if r[5] == "Interface") == 1}
    got = {(r.repo, r.path, r.call): r.method_ord for r in linking.assign_call(asked, decls).collect()}
    assert {k: got.get(k) for k in asked_once} == asked_once and len(asked_once) > 10 and set(got) == set(calls)


def test_a_file_of_100_000_nested_spans(spark):
    """All spans nest, so the pairs are 2.5 billion."""
    n = 50_000
    i = F.col("id") % n
    kind = F.when(F.col("id") < n, "Class").otherwise("Method")
    decls = spark.range(2 * n).select(F.lit("r").alias("repo"), F.lit("c").alias("commit_sha"), F.lit("p").alias("path"), F.col("id").alias("ord"), F.concat(F.lit("N"), "id").alias("name"), kind.alias("kind"), i.alias("start"), (10 * n - i).alias("end"))
    rows = linking.assign_owner(decls)[0].filter("kind = 'Method'")
    assert rows.filter(F.col("owner") == F.concat(F.lit("N"), F.col("ord") - n)).count() == n
    calls = decls.filter("kind = 'Class'").withColumnRenamed("ord", "call")
    assert linking.assign_call(calls, decls).filter(f"method_ord = {n}").count() == n


def test_no_spans(spark):
    none = spark.createDataFrame([], DECL)
    assert linking.assign_owner(none)[0].count() == 0
    assert linking.assign_call(none.withColumnRenamed("ord", "call"), none).count() == 0
