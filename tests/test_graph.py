import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lattice.operators import graph as G
from lattice.operators import rules as R
from lattice.operators import snapshots as M

EDGE = "repo string, commit_sha string, from_key string, to_key string, type string, evidence string, confidence double, is_static boolean"


def edges(spark, *pairs, commit="s1", kind="Calls"):
    return spark.createDataFrame([("r", commit, p[0], p[1], p[2] if len(p) > 2 else kind, None, 1.0, True) for p in pairs], EDGE)


def nodes(spark, *keys, commit="s1", content=None, paths=None, kinds=None):
    rows = [("r", commit, k, k, (paths or {}).get(k, f"{k}.cs"), (kinds or {}).get(k, "Class"), 1, 9, (content or {}).get(k, f"# {k}"), 1.0, None, "none", f"s-{k}{(content or {}).get(k, '')}") for k in keys]
    return spark.createDataFrame(rows, "repo string, commit_sha string, key string, symbol string, path string, kind string, start_line int, end_line int, content string, confidence double, model string, review_status string, semantic_hash string")


def start(spark, *keys, commit="s1"):
    return spark.createDataFrame([("r", commit, k) for k in keys], "repo string, commit_sha string, source string")


def test_impact_and_chain(spark):
    n, e = nodes(spark, "A", "B", "C", "D", "E"), edges(spark, ("B", "A"), ("C", "B"), ("D", "A"), ("E", "D"))
    rows = {r.key: r for r in G.impact(n, e, start(spark, "A")).collect()}
    assert set(rows) == {"B", "C", "D", "E"}
    assert {k for k, r in rows.items() if r.severity == "direct"} == {"B", "D"}
    assert rows["C"].depth == 2 and rows["C"].trace == ["A", "B", "C"]
    assert G.impact(n, e, start(spark, "ghost")).count() == 0
    line = G.chain(nodes(spark, "Controller", "Service", "Repo"), edges(spark, ("Controller", "Service"), ("Service", "Repo"), ("Repo", "Db")), start(spark, "Controller"))
    assert [(r.key, r.depth, r.path, r.line) for r in line.orderBy("depth").collect()] == [("Service", 1, "Service.cs", 1), ("Repo", 2, "Repo.cs", 1), ("Db", 3, "", 0)]


def test_search_on_a_cycle_keeps_the_least_trace(spark):
    e = edges(spark, ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"))
    rows = {r.key: (r.depth, r.trace) for r in G.search(e, start(spark, "A"), 10).collect()}
    assert rows == {"A": (0, ["A"]), "B": (1, ["A", "B"]), "C": (1, ["A", "C"]), "D": (2, ["A", "B", "D"])}


def test_consumers_and_neighborhood(spark):
    n, e = nodes(spark, "A", "B", "C"), edges(spark, ("B", "A"), ("C", "A"), ("D", "C"))
    assert [r.key for r in G.consumers(n, e, start(spark, "A")).orderBy("key").collect()] == ["B", "C"]
    assert {r.key for r in G.neighborhood(e, start(spark, "A", "Z"), 1).filter("source = 'A'").collect()} == {"A", "B", "C"}
    assert [r.key for r in G.neighborhood(e, start(spark, "Z"), 2).collect()] == ["Z"]


def test_diff_and_new_cycle(spark):
    a, b = edges(spark, ("A", "B"), ("B", "C")), edges(spark, ("A", "B"), ("B", "C"), ("C", "A"), ("D", "B"), commit="s2")
    na, nb = nodes(spark, "A", "B", "C"), nodes(spark, "A", "B", "C", "D", commit="s2", content={"C": "# new"})
    assert {(r.key, r.change) for r in G.diff_nodes(na, nb).collect()} == {("D", "added"), ("C", "changed")}
    assert {(r.from_key, r.to_key, r.change) for r in G.diff_edges(a, b).collect()} == {("C", "A", "added"), ("D", "B", "added")}
    assert [r.cycle for r in G.new_cycles(a, b).collect()] == [["A", "B", "C", "A"]]
    assert [r.cycle for r in G.simple_cycles(edges(spark, ("A", "A"), ("A", "B"))).collect()] == [["A", "A"]]


def test_degree(spark):
    rows = G.top_by_degree(nodes(spark, "A", "B", "C", "D"), edges(spark, ("C", "A"), ("B", "A"), ("A", "D"))).orderBy("rank").collect()
    assert [(r.key, r.degree) for r in rows] == [("A", 3), ("B", 1), ("C", 1), ("D", 1)]


@pytest.mark.parametrize("n, rating", [(1, "LOW"), (4, "MEDIUM"), (15, "HIGH")])
def test_rating(spark, n, rating):
    keys = [f"n{i}" for i in range(n)]
    assert G.impact_report(nodes(spark, "A", *keys), edges(spark, *((k, "A") for k in keys)), start(spark, "A")).first().rating == rating


def test_class_of_a_test_wins(spark):
    n = nodes(spark, "A", "T", "S", "U", paths={"T": "tests/OrdersApiTests.cs", "S": "src/storage/S.cs"})
    e = edges(spark, ("T", "A", "InvokesEndpoint"), ("U", "S", "Injected"))
    got = {r.key: r.classification for r in G.classify_impact(n.select("repo", "commit_sha", "key", "path"), n, e).collect()}
    assert got == {"A": "api-contract", "T": "test", "S": "database-entity", "U": "database-entity"}


def snaps(spark, *commits):
    return spark.createDataFrame([("r", c, dt.datetime(2024, 1, i + 1)) for i, c in enumerate(commits)], "repo string, commit_sha string, created_at timestamp")


def test_history_closes_and_reopens_and_steps_agree(spark):
    e = edges(spark, ("A", "B"), ("X", "Y")).unionByName(edges(spark, ("X", "Y"), commit="s2")).unionByName(edges(spark, ("A", "B"), ("X", "Y"), commit="s3"))
    s = snaps(spark, "s1", "s2", "s3")
    key = lambda df: sorted((r.from_key, r.introduced_commit, r.live) for r in df.collect())
    batch = M.edge_history(e, s)
    assert key(batch) == [("A", "s1", False), ("A", "s3", True), ("X", "s1", True)]
    h = M.edge_history(e, s).limit(0)
    for i, c in enumerate(("s1", "s2", "s3")):
        h = M.edge_history_step(h, e.filter(F.col("commit_sha") == c), c, F.lit(dt.datetime(2024, 1, i + 1)))
    assert key(h) == key(batch)
    seen = G.edge_history_lookup(batch, e.filter("commit_sha = 's3'"), e.select("repo", "from_key", "to_key").distinct(), F.lit("2024-01-31").cast("date")).collect()
    assert {(r.from_key, r.age_days, r.exists_now) for r in seen} == {("A", 28, True), ("X", 30, True)}


def test_scc_and_hashes(spark):
    e = edges(spark, ("A", "B"), ("B", "A"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "C"), ("E", "F"), ("G", "G"))
    assert {r.key: r.component for r in M.scc(e).collect()} == {"A": "A", "B": "A", "C": "C", "D": "C", "E": "C", "F": "F", "G": "G"}
    keys = "A B C D E F G".split()
    h = lambda **c: {r.key: r.semantic_hash for r in M.semantic_hash(nodes(spark, *keys, content=c), e).collect()}
    one, two, cycle = h(), h(F="# other"), h(D="# other")
    assert one == h()
    assert {k for k in keys if one[k] != two[k]} == {"A", "B", "C", "D", "E", "F"}
    assert {k for k in keys if one[k] != cycle[k]} == {"A", "B", "C", "D", "E"}


def test_hash_cascades_over_a_chain(spark):
    keys = [f"n{i:02d}" for i in range(6)]
    e = edges(spark, *zip(keys, keys[1:]))
    h = lambda c: {r.key: r.semantic_hash for r in M.semantic_hash(nodes(spark, *keys, content=c), e).collect()}
    one, two = h({}), h({keys[-1]: "# new"})
    assert all(one[k] != two[k] for k in keys)


def test_missing_snapshot_is_an_error(spark):
    with pytest.raises(LookupError):
        M.require_snapshot(snaps(spark, "s1"), "r", "nope")


RULES = [{"name": "deny", "severity": "error", "deny": {"from": {"path": "Domain/"}, "to": {"path": "infrastructure/"}}}]


def test_deny_and_require(spark):
    n = nodes(spark, "A", "B", "C", paths={"A": "Domain/A.cs", "B": "Infrastructure/B.cs", "C": "Api/C.cs"})
    e = edges(spark, ("A", "B"), ("A", "C"))
    assert [(r.from_key, r.to_key) for r in R.deny_violations(R.load_rules(spark, RULES), n, e).collect()] == [("A", "B")]
    need = R.load_rules(spark, [{"name": "need", "require": {"from": {"kind": "Class"}, "to": {"kind": "Interface"}}}])
    assert [(r.rule, r.from_key, r.type) for r in R.require_violations(need, n, e).collect()] == [("need", "", None)]
    assert R.require_violations(R.load_rules(spark, [{"name": "any", "require": {"from": {"kind": "class"}}}]), n, e).count() == 0


@pytest.mark.parametrize("rule", [{"deny": {"from": {"path": "a"}, "to": {"path": "b"}}}, {"name": "x", "severity": "fatal", "require": {"from": {"path": "a"}}}, {"name": "x"}, {"name": "x", "deny": {"from": {"path": "a"}}}, {"name": "x", "require": {"from": {}}}, {"name": "x", "require": {"from": {"kind": "Nope"}}}, {"name": "x", "require": {"from": {"path": "a"}, "to": {}}}, {"name": "x", "deny": {"from": {"path": "a"}, "to": {"path": "b"}}, "require": {"from": {"path": "a"}}}])
def test_bad_rules(spark, rule):
    with pytest.raises(ValueError):
        R.load_rules(spark, [rule])


def test_drift_and_introduction(spark):
    paths = {"A": "Domain/A.cs", "B": "Infrastructure/B.cs"}
    n = nodes(spark, "A", "B", paths=paths)
    for c in ("s2", "s3"):
        n = n.unionByName(nodes(spark, "A", "B", commit=c, paths=paths))
    e = edges(spark, ("A", "B")).unionByName(edges(spark, ("B", "A"), commit="s2")).unionByName(edges(spark, ("A", "B"), commit="s3"))
    s = snaps(spark, "s1", "s2", "s3")
    rules = R.load_rules(spark, RULES)
    row = R.rule_drift(rules, n, e, s).first()
    assert (row.first_commit, row.is_live) == ("s1", True)
    late = R.introduced_commit(R.rule_drift(rules, n, e, s, frm="s3"), M.edge_history(e, s)).first()
    assert (late.first_commit, late.introduced_commit) == ("s3", "s3")
    still = edges(spark, ("A", "B")).unionByName(edges(spark, ("A", "B"), commit="s2")).unionByName(edges(spark, ("A", "B"), commit="s3"))
    assert R.introduced_commit(R.rule_drift(rules, n, still, s, frm="s3"), M.edge_history(still, s)).first().introduced_commit == "s1"


def test_search_holds_numbers_and_traces_come_at_the_end(spark, monkeypatch):
    """Against brute force on random graphs of two snapshots; no level that the search writes holds a list."""
    import random

    rng, written = random.Random(3), []
    real = G.cut_and_count
    monkeypatch.setattr(G, "cut_and_count", lambda df, *a: (written.append(dict(df.dtypes)), real(df, *a))[1])
    rows = [("r", c, f"k{rng.randrange(30):02}", f"k{rng.randrange(30):02}") for c in ("a", "b") for _ in range(70)]
    e = spark.createDataFrame(rows, "repo string, commit_sha string, from_key string, to_key string")
    s = spark.createDataFrame([("r", c, k) for c in ("a", "b") for k in ("k01", "k02", "none")], "repo string, commit_sha string, source string")
    expected = {}
    for c in ("a", "b"):
        for src in ("k01", "k02", "none"):
            level = {src: (src,)}
            seen = dict(level)
            for _ in range(5):
                new = {}
                for at, t in level.items():
                    for _, x, f, to in rows:
                        if x == c and f == at and to not in seen:
                            new[to] = min(new.get(to, (*t, to)), (*t, to))
                level = new
                seen |= new
            expected |= {(c, src, k): t for k, t in seen.items()}
    found = G.search(e, s, 5, parent=True).collect()
    assert {(r.commit_sha, r.source, r.key): tuple(r.trace) for r in found} == expected and len(found) == len(expected) > 60
    assert all(r.parent == (r.trace[-2] if r.depth else None) and r.depth == len(r.trace) - 1 for r in found)
    assert written and all(kind in ("bigint", "int") for level in written for kind in level.values())


def test_paths_that_meet_no_way_back_are_not_kept(spark, monkeypatch):
    wide, layers, most = 7, 8, []
    keep = G.cut

    def counted(df):
        df = keep(df)
        most.append(df.count())
        return df

    monkeypatch.setattr(G, "cut", counted)
    ring = [(f"{i}-{a}", f"{(i + 1) % layers}-{b}") for i in range(layers) for a in range(wide) for b in range(wide)]
    assert G.simple_cycles(edges(spark, *ring)).isEmpty()
    assert max(most) < 2500  # of 5,000 paths of three edges


@pytest.mark.parametrize("most", [4, 5])
def test_cycles_equal_a_walk(spark, most):
    rnd = random.Random(most)
    pairs = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(30)}
    walks, expected = [[a] for a in range(9)], []
    for _ in range(most):
        walks = [[*w, b] for w in walks for a, b in pairs if a == w[-1] and (b not in w[1:]) and b >= w[0]]
        expected += [w for w in walks if w[-1] == w[0]]
        walks = [w for w in walks if w[-1] != w[0]]
    found = G.simple_cycles(edges(spark, *((str(a), str(b)) for a, b in pairs)), most).collect()
    assert sorted(r.cycle for r in found) == sorted([str(x) for x in w] for w in expected)
