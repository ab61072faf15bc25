import random
from collections import Counter

import pytest

from lattice.functions import tables
from lattice.operators import snapshots as S

EDGE = "repo string, commit_sha string, from_key string, to_key string, type string"


def brute(edges):
    """Least member of each node's component, by closing over reachability."""
    nodes = {x for e in edges for x in e}
    ahead = {n: {b for a, b in edges if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for x in ahead[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        reach[n] = seen
    return {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}


def frame(spark, edges, snaps=("c0",)):
    return spark.createDataFrame([("r", s, f"k{a:05d}", f"k{b:05d}", "Calls") for s in snaps for a, b in edges], EDGE)


def found(df):
    return {(r.commit_sha, int(r.key[1:])): int(r.component[1:]) for r in S.scc(df).collect()}


@pytest.mark.parametrize("small", [0, S.SMALL])
def test_components_with_and_without_the_finish_in_tasks(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rnd = random.Random(small)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)] + [(100 + i, 101 + i) for i in range(40)] + [(140, 120), (7, 100), (200, 200), (300, 301), (301, 300)]
    expected = brute(edges)
    assert found(frame(spark, edges, ("c0", "c1"))) == {(s, k): v for s in ("c0", "c1") for k, v in expected.items()}


def test_a_long_ring_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 0)
    rounds, n = Counter(), 10_000
    keep = S.cut_and_count

    def counted(*a):
        rounds["n"] += 1
        return keep(*a)

    monkeypatch.setattr(S, "cut_and_count", counted)
    assert set(found(frame(spark, [(i, (i + 1) % n) for i in range(n)])).values()) == {0}
    assert rounds["n"] < 25


@pytest.mark.parametrize("known", [False, True])
def test_hashes_of_levels_equal_hashes_in_tasks(spark, monkeypatch, known):
    rnd = random.Random(4)
    edges = [(rnd.randrange(15), rnd.randrange(15)) for _ in range(16)] + [(3, 3)]
    nodes = spark.createDataFrame([("r", s, f"k{i:05d}", f"text é {i % 3} {s if i % 7 == 0 else ''}") for s in ("c0", "c1") for i in range(16)], "repo string, commit_sha string, key string, content string")
    over = spark.createDataFrame([("r", "c0", "k00005", "x" * 64)], "repo string, commit_sha string, key string, semantic_hash string") if known else None
    both = []
    for small in (0, S.SMALL):
        monkeypatch.setattr(S, "SMALL", small)
        both.append(sorted(map(tuple, S.semantic_hash(nodes, frame(spark, edges, ("c0", "c1")), over).collect())))
    assert both[0] == both[1] and len(both[0]) == 32


def test_a_pile_keeps_few_parts(spark):
    pile = tables.Pile()
    for i in range(70):
        pile.add(tables.cut(spark.range(i, i + 1)))
        assert pile.scans <= 2 * tables.Pile.FAN
    assert sorted(r.id for r in pile.all().collect()) == list(range(70))


def test_a_thin_group_is_trimmed_beside_a_dense_one(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 5)
    rows = [(1, a, b) for a in range(20) for b in range(20) if a != b] + [(2, 100 + i, 101 + i) for i in range(19)]
    left, n, few = S.trimmed(spark.createDataFrame(rows, "g long, src long, dst long"), len(rows))
    assert n == left.count() == 380 and few.count() <= 5 and left.filter("g = 2").isEmpty()


def test_edges_inside_a_component_send_no_messages(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 0)
    sent = []

    class Kept(tables.Pile):
        def add(self, part):
            sent.extend(part.select("part").collect() if "part" in part.columns else ())
            super().add(part)

        def __init__(self, *parts):
            super().__init__()
            for part in parts:
                self.add(part)

    monkeypatch.setattr(S, "Pile", Kept)
    edges = [(a, b) for a in range(5) for b in range(5) if a != b] + [(4, 9)]
    nodes = spark.createDataFrame([("r", "c0", f"k{i:05d}", "x") for i in (*range(5), 9)], "repo string, commit_sha string, key string, content string")
    assert S.semantic_hash(nodes, frame(spark, edges)).count() == 6 and len(sent) == 1
