"""The impact report holds its tables with traces, in parts; searches on numbers equal those on keys."""

from pyspark.sql import functions as F

from lattice.operators import graph as G
from lattice.operators import textgen as T
from lattice.plans import queries_text as Q
from tests.test_graph import edges, nodes, start


def test_the_report_has_every_line_with_its_trace(spark):
    n, e = nodes(spark, "A", "B", "C", "D", "Z"), edges(spark, ("B", "A"), ("D", "A"), ("C", "B"), ("C", "D"), ("A", "Z"))
    rows = {(r.source, r.severity, r.part): (r.n, r.body) for r in T.report_impact(n, e, 10, 10, lines=1).collect()}
    assert rows["A", "direct", 0] == (1, "| `B` | B | `B.cs:1` | 1 | `A` -> `B` |") and rows["A", "direct", 1][1].endswith("| `A` -> `D` |")
    assert rows["A", "indirect", 0] == (1, "| `C` | C | `C.cs:1` | 2 | `A` -> `B` -> `C` |")
    assert rows["C", None, 0] == (0, "No affected entities.") and ("Z", "indirect", 2) in rows
    whole = {(r.source, r.severity): r for r in T.report_impact(n, e).collect()}
    assert whole["Z", "indirect"].n == 3 and whole["Z", "indirect"].body.count("\n") == 2 and {r.part for r in whole.values()} == {0}


def test_the_query_has_the_bodies(spark):
    rows = Q.QUERIES["t12_impact"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.body.count("\n") == r.n - 1 and r.body.count(" -> ") >= r.n for r in rows if r.n) and sum(r.n for r in rows) > 10_000


def test_a_search_on_numbers_equals_one_on_keys(spark):
    e = edges(spark, ("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "A"), ("D", "E"))
    names = spark.createDataFrame([(i, k) for i, k in enumerate("ABCDE")], "id long, key string")
    ends = e.select(F.expr("ascii(from_key) - 65L").alias("at"), F.expr("ascii(to_key) - 65L").alias("next"))
    found = {(chr(65 + r.source), r.trace[-1], r.depth, tuple(r.trace)) for r in G.reached(ends, spark.range(2).select(F.col("id").alias("source")), 10, names).collect()}
    assert found == {(r.source, r.key, r.depth, tuple(r.trace)) for r in G.search(e, start(spark, "A", "B"), 10).collect()} and len(found) == 10
