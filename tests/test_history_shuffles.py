"""The history of edges deals them once; the stream's query carries digits for keys."""

from lattice.operators import graph as G
from lattice.operators import snapshots as M
from lattice.plans import fixtures as X
from tests.test_graph import EDGE


def test_edges_are_dealt_once(spark, tmp_path):
    import datetime as dt

    rows = [("r", f"s{i}", f"k{j}", f"k{j + 1}", "Calls", None, 1.0, True) for i in range(3) for j in range(9) if (i, j) != (1, 4)]
    spark.createDataFrame(rows, EDGE).write.parquet(f"{tmp_path}/e")
    s = spark.createDataFrame([("r", f"s{i}", dt.datetime(2024, 1, i + 1)) for i in range(3)], "repo string, commit_sha string, created_at timestamp")
    found = M.edge_history(spark.read.parquet(f"{tmp_path}/e"), s)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "from_key" in line for line in plan.split("\n")) == 1
    got = {(r.from_key, r.introduced_commit, r.live) for r in found.collect()}
    assert got == {(f"k{j}", "s0", j != 4) for j in range(9)} | {("k4", "s2", True)}


def test_digits_stand_for_keys(spark):
    sf = "/root/testdata/sf0.001"
    X._PAIRS.clear()
    columns = [*G.SNAP, "from_key", "to_key", "type", "confidence"]
    edges, keys = X.in_digits(spark, sf)
    short = edges.select(*columns)
    assert all(r.from_key.isdigit() and r.to_key.isdigit() for r in short.limit(50).collect())
    plain = X.edges(spark, sf).select(*columns)
    assert X.spelled(short, keys).exceptAll(plain).isEmpty() and plain.count() == short.count()
