import random

from pyspark.sql import functions as F

from lattice.operators import graph as G
from lattice.operators import reviews as R

NODE = "repo string, commit_sha string, key string, symbol string, path string, kind string, start_line int, end_line int, content string, confidence double, model string, review_status string, semantic_hash string"
EDGE = "repo string, commit_sha string, from_key string, to_key string, type string, confidence double, is_static boolean, evidence string"
SNAPS = [("r", "c0"), ("r", "c1"), ("q", "c0")]  # keys and commits of repositories overlap


def graph(spark, seed, n=40, m=90):
    rnd = random.Random(seed)
    edges = {s: {(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)} for s in SNAPS}
    e = spark.createDataFrame([(*s, f"k{a}", f"k{b}", "Calls", 1.0, True, "e") for s, pairs in edges.items() for a, b in pairs], EDGE)
    v = spark.createDataFrame([(*s, f"k{i}", f"s{i}", f"src/f{i // 4}.py/{i}", "Class", 1, 2, "", 1.0, None, "none", "h") for s in SNAPS for i in range(n)], NODE)
    return v, e


def test_groups_of_sources_arrive_when_a_plain_search_arrives(spark):
    v, e = graph(spark, 1)
    sources = v.select(*G.SNAP, F.col("key").alias("source")).distinct()  # 120 sources, two words
    slots = G.in_words(sources, 64)
    levels, names = G.bit_search(e, slots.select(*G.SNAP, F.col("source").alias("key"), "word", F.col("nth").alias("bit")), 10, reverse=True)
    slot = {(r.word, r.nth): (r.repo, r.commit_sha, r.source) for r in slots.collect()}
    name = {r.id: r.key for r in names.collect()}
    got = {(*slot[r.word, b], name[r.id]): r.depth for r in levels.collect() for b in range(64) if r.bits >> b & 1}
    assert got == {(r.repo, r.commit_sha, r.source, r.key): r.depth for r in G.search(e, sources, 10, reverse=True).filter("depth > 0").collect()}


def test_pull_requests_counted_without_rows(spark):
    for seed in (2, 3):
        v, e = graph(spark, seed)
        prs = spark.createDataFrame([(100 * i + j, repo, "b", commit) for i, (repo, commit) in enumerate(SNAPS) for j in range(12)], "pr long, repo string, base_commit string, head_commit string")
        changed = spark.createDataFrame([(100 * i + j, f"src/f{k}.py") for i in range(3) for j in range(12) for k in {j % 10, (j * 7) % 10}], "pr long, path string")
        for most, depth in ((30, 3), (5, 2), (1, 4)):
            rows = R.pr_impact(prs, changed, v, e, most, depth).groupBy("pr").agg(F.count(F.lit(1)).alias("impacted"), F.count_if(F.col("depth") == 1).alias("direct"), F.max("depth").alias("max_depth"))
            assert sorted(map(tuple, R.pr_impact_counts(prs, changed, v, e, most, depth).collect())) == sorted(map(tuple, rows.collect()))


def test_nothing_to_search(spark):
    v, e = graph(spark, 4)
    none = v.limit(0).select(*G.SNAP, F.col("key").alias("source"))
    assert G.impact_report(v, e, none).collect() == []
    assert G.impact_report(v, e.limit(0), v.limit(1).select(*G.SNAP, F.col("key").alias("source"))).first().total == 0
