import pandas as pd
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lattice.operators import cost, linking, retrieval, reviews, udf
from lattice.operators import snapshots as M
from lattice.sources import scan
from lattice.streaming import streams
from tests.test_graph import edges, nodes, snaps


def test_scan_and_languages(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.PY").write_text("x = 1\n")
    (tmp_path / "b.md").write_text("no")
    rows = scan.scan_tree(spark, f"file://{tmp_path}", "r", "c1")
    assert {(r.path, r.content) for r in rows.collect()} == {("src/a.PY", "x = 1\n"), ("b.md", "no")}
    assert [(r.path, r.language) for r in scan.with_language(rows).collect()] == [("src/a.PY", "python")]


def test_parse_dump(spark, tmp_path):
    doc = {"commitSha": "c1", "defaultBranch": "main", "entities": [{"key": "a::A", "path": "a", "symbol": "A", "kind": "interface", "startLine": 3, "endLine": 9}, {"key": "b::B", "kind": "what"}], "relationships": [{"from": "a::A", "to": "b::B", "type": "fielddependency"}, {"from": "a::A", "to": "b::B", "type": "?", "confidence": 0.5, "isStatic": False}], "diagnostics": ["d"]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    e, r, d = scan.read_parse_dump(spark, str(tmp_path), "r")
    assert [(x.ord, x.kind) for x in e.orderBy("ord").collect()] == [(0, "Interface"), (1, "Class")]
    assert [(x.type, x.confidence, x.is_static) for x in r.orderBy("ord").collect()] == [("FieldDependency", 1.0, True), ("References", 0.5, False)]
    assert d.first().diagnostic == "d"


def test_snapshots_are_replaced_and_documents_stored_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    head = lambda c, at: spark.createDataFrame([("r", c, "root", at)], "repo string, commit_sha string, root_hash string, created_at timestamp")
    for c, day, keys in (("s1", 1, "AB"), ("s2", 2, "ABC"), ("s1", 1, "A")):
        scan.write_snapshot(nodes(spark, *keys, commit=c), edges(spark, ("A", "B"), commit=c), head(c, dt.datetime(2024, 1, day)), path)
    assert {r.key for r in scan.read_snapshot(spark, path, "r")[0].collect()} == {"A", "B", "C"}
    assert {r.key for r in scan.read_snapshot(spark, path, "r", "s1")[0].collect()} == {"A"}
    assert spark.read.parquet(f"{path}/objects").count() == 3  # the first document of this root only
    with pytest.raises(LookupError):
        scan.read_snapshot(spark, path, "r", "nope")
    doc = json.loads(spark.read.parquet(f"{path}/objects").filter("part = 'node'").first().json)
    assert list(doc) == list(scan.NODE_FIELDS)
    assert scan.read_snapshot(spark, path, "r", "s2")[1].count() == 1
    scan.write_snapshot(nodes(spark, "B", commit="s2"), edges(spark, ("A", "B")).limit(0), head("s2", dt.datetime(2024, 1, 2)), path)
    n, e = scan.read_snapshot(spark, path, "r")
    assert [r.key for r in n.collect()] == ["B"] and e.collect() == [] and "from_key" in e.columns
    every = scan.read_snapshots(spark, path)
    assert sorted((r.commit_sha, r.key) for r in every[0].collect()) == [("s1", "A"), ("s2", "B")] and [r.commit_sha for r in every[1].collect()] == ["s1"]


def test_a_store_without_any_edge(spark, tmp_path):
    head = spark.createDataFrame([("r", "s1", "root", dt.datetime(2024, 1, 1))], "repo string, commit_sha string, root_hash string, created_at timestamp")
    scan.write_snapshot(nodes(spark, "A", commit="s1"), edges(spark, ("A", "B")).limit(0), head, f"file://{tmp_path}/store")
    n, e = scan.read_snapshot(spark, f"file://{tmp_path}/store", "r", "s1")
    assert n.count() == 1 and e.count() == 0


def test_summariser_sees_each_entity_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def fn(pdf):
        seen.add(len(pdf))
        if "B" in set(pdf["key"]):
            raise RuntimeError("no answer")
        return pd.DataFrame({"repo": pdf["repo"], "commit_sha": pdf["commit_sha"], "key": pdf["key"], "content": "made", "confidence": 0.9, "model": "m", "prompt_version": "1"})

    e = nodes(spark, "A", "B", "C").withColumns({"source": F.lit("x"), "language": F.lit("python")}).repartition(3, "key")
    with pytest.warns(UserWarning, match="rule-based summaries; RuntimeError: no answer"):
        out = udf.summarize_with(e, edges(spark, ("A", "B")).withColumn("ord", F.lit(1)), fn)
    assert sorted((r.key, r.model == "m") for r in out.collect()) in ([("A", True), ("B", False), ("C", True)], [("A", False), ("B", False), ("C", True)], [("A", True), ("B", False), ("C", False)], [("A", False), ("B", False), ("C", False)])
    assert seen.value == 3


def test_report_round_trip(spark, tmp_path):
    n = nodes(spark, "A", "B").select("key", "path")
    scan.write_report({"nodes": n}, f"file://{tmp_path}/rep")
    assert scan.read_report(spark, f"file://{tmp_path}/rep", {"nodes": "key string, path string"})["nodes"].exceptAll(n).count() == 0


def test_budget_refusals_use_nothing(spark):
    rows = [("r", dt.datetime(2024, 1, 1, h), h, t) for h, t in enumerate([600, 500, 400, 1])] + [("r", dt.datetime(2024, 1, 2), 9, 1000)]
    got = cost.admit_requests(spark.createDataFrame(rows, "repo string, ts timestamp, ord long, tokens long"), 1000)
    assert [r.admitted for r in got.orderBy("ord").collect()] == [True, False, True, False, True]


def test_ambiguous_names_make_no_edge(spark):
    rows = [("r", "c", "f1", 0, "f1::Repo", "Repo", "Class", 1, []), ("r", "c", "f2", 1, "f2::Repo", "Repo", "Class", 1, []), ("r", "c", "f3", 2, "f3::Svc", "Svc", "Class", 1, ["Repo", "Only"]), ("r", "c", "f4", 3, "f4::Only", "Only", "Class", 1, [])]
    e = spark.createDataFrame(rows, "repo string, commit_sha string, path string, ord int, key string, symbol string, kind string, start_line int, field_types array<string>")
    local = linking.link_fields_local(e)
    assert [(r.from_key, r.to_key) for r in linking.link_types_global(e, local, "field_types", "FieldDependency", 0.7).collect()] == [("f3::Svc", "f4::Only")]
    names = e.select("repo", "commit_sha", F.col("key").alias("from_key"), F.explode("field_types").alias("name"))
    assert [(r.name, r.candidates) for r in linking.ambiguous_refs(names, e).collect()] == [("Repo", "f1::Repo, f2::Repo")]


def test_proposals(spark):
    good = {"from": "A", "to": "B", "type": "Calls", "confidence": 3}
    text = "```json\n" + json.dumps([good, good, {"from": "A", "to": "ghost", "type": "Calls"}, {"from": "B", "to": "A", "type": "Injected"}, {"from": "A", "to": "A", "type": "Calls"}]) + "\n```"
    df = spark.createDataFrame([("r", "s1", text), ("r", "s1", "not json")], "repo string, commit_sha string, json string")
    got = linking.accept_proposals(df, nodes(spark, "A", "B"), edges(spark, ("B", "A"))).collect()
    assert [(r.from_key, r.to_key, r.confidence, r.is_static) for r in got] == [("A", "B", 1.0, False)]


def test_pull_request(spark):
    n = nodes(spark, "Impl", "Svc", commit="h").unionByName(nodes(spark, "Impl", "Svc", commit="b"))
    e = edges(spark, ("Impl", "Svc"), commit="h")
    prs = spark.createDataFrame([(1, "r", "b", "h"), (2, "r", "gone", "h")], "pr int, repo string, base_commit string, head_commit string")
    changed = spark.createDataFrame([(1, "Svc.cs")] + [(2, f"f{i:02d}") for i in range(25)], "pr int, path string")
    impact, delta = reviews.pr_impact(prs, changed, n, e), reviews.pr_edge_delta(prs, e, snaps(spark, "b", "h"))
    rows = {r.pr: r for r in reviews.pr_report(prs, changed, impact, delta).collect()}
    assert (rows[1].impacted, rows[1].added_edges, rows[1].base_known) == (1, 1, True)
    assert (rows[2].base_known, rows[2].impacted) == (False, 0)
    body = {r.pr: r.body for r in reviews.render_pr(reviews.pr_report(prs, changed, impact, delta)).collect()}
    assert "... and 5 more" in body[2] and "unavailable" in body[2] and "`Svc.cs`" in body[1]


def test_default_functions(spark):
    n = nodes(spark, "A", "B").withColumn("language", F.lit("go"))
    assert udf.summarize_with(n, edges(spark, ("A", "B")).withColumn("ord", F.lit(1))).filter("model = 'rule-based' and confidence = 0.6").count() == 2
    v = retrieval.embed_nodes(n, n.limit(0), n.limit(0).select("repo", "semantic_hash", "key", F.array(F.lit(0.0).cast("float")).alias("vector")), udf.hashed_words(8)).collect()
    assert len(v) == 2 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in v)


def _run(query, name):
    q = query.format("memory").queryName(name).outputMode("update").start()
    q.processAllAvailable()
    q.stop()


STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@pytest.fixture
def rocks(spark):
    for k, v in STATE.items():
        spark.conf.set(k, v)
    yield spark
    for k in STATE:
        spark.conf.unset(k)


def test_repo_state_stream(rocks, tmp_path):
    spark, schema = rocks, "repo string, ord long, event string, action string, name string, clone_url string, branch string, status string, installation_id long"
    rows = [
        ("o/known", 1, "known", None, "known", "u", "main", "ready", 7), ("o/known", 2, "push", None, "", None, "dev", None, None), ("o/known", 3, "push", None, None, None, None, None, None),
        ("o/new", 1, "installation", "created", None, None, None, None, 9), ("o/none", 1, "push", None, "x", None, None, None, None),
        ("o/off", 1, "installation", "added", None, None, None, None, 9), ("o/off", 2, "installation", "removed", None, None, None, None, None), ("o/off", 3, "push", None, None, None, None, None, None),
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = streams.stream_repo_state(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    _run(out.writeStream.option("checkpointLocation", str(tmp_path / "cp")), "repo_state")
    got = {r.repo: (r.name, r.clone_url, r.branch, r.status) for r in spark.table("repo_state").collect()}
    assert got == {"o/known": ("known", "u", "dev", "pending"), "o/new": ("new", "https://github.com/o/new.git", None, "pending"), "o/off": ("off", "https://github.com/o/off.git", None, "disconnected")}


def test_pr_queue_stream(rocks, tmp_path):
    spark, schema = rocks, "repo string, number long, head string, base string, ord long, event string, action string"
    rows = [("r", 1, "h1", "b1", 1, "pull_request", "opened"), ("r", 1, "h1", "b1", 2, "pull_request", "synchronize"), ("r", 1, "h2", "b1", 3, "pull_request", "closed"), ("r", 1, "h1", None, 4, "review_result", "failed"), ("r", 1, "h1", "b2", 5, "pull_request", "reopened")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = streams.stream_pr_queue(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    _run(out.writeStream.option("checkpointLocation", str(tmp_path / "cp")), "pr_queue")
    assert sorted((r.head, r.base, r.attempt) for r in spark.table("pr_queue").collect()) == [("h1", "b1", 1), ("h1", "b2", 2)]


def test_budget_stream(rocks, tmp_path):
    spark, schema = rocks, "repo string, ts timestamp, ord long, tokens long"
    rows = [("r", dt.datetime(2024, 1, 1, h), h, t) for h, t in enumerate([600, 500, 400, 1])]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = streams.stream_admit(spark.readStream.schema(schema).json(str(tmp_path / "in")), 1000)
    q = out.writeStream.format("memory").queryName("admit").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.admitted for r in spark.table("admit").orderBy("ord").collect()] == [True, False, True, False]


def test_edge_history_stream_takes_a_commit_in_parts(spark, tmp_path):
    schema = "repo string, commit_sha string, from_key string, to_key string, type string, created_at timestamp"
    e = lambda c, d, *p: [("r", c, a, b, "Calls", dt.datetime(2024, 1, d)) for a, b in p]
    src, out = tmp_path / "in", f"file://{tmp_path}/h"
    every = []
    for c, d, p in (("s1", 1, [("A", "B"), ("X", "Y")]), ("s2", 2, [("X", "Y")]), ("s3", 3, [("A", "B")]), ("s2", 2, [("C", "D"), ("X", "Y")]), ("s3", 3, [("X", "Y")])):
        spark.createDataFrame(e(c, d, *p), schema).coalesce(1).write.mode("append").json(str(src))
        every += e(c, d, *p)
        q = streams.stream_edge_history(spark.readStream.schema(schema).json(str(src)), out, str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    key = lambda df: sorted((r.from_key, r.introduced_commit, r.live) for r in df.collect())
    got = key(streams.read_edge_history(spark, out))
    assert got == key(M.edge_history(spark.createDataFrame(every, schema).distinct(), snaps(spark, "s1", "s2", "s3")))
    assert got == [("A", "s1", False), ("A", "s3", True), ("C", "s2", False), ("X", "s1", True)]


def test_pr_queue_forgets_after_the_watermark(rocks, tmp_path):
    spark, schema = rocks, "repo string, number long, head string, base string, ord long, event string, action string, ts timestamp"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    opened = lambda head, d: ("r", 1, head, "b", d, "pull_request", "opened", day(d))
    steps = [opened("h1", 0), opened("h1", 20), opened("x", 45), opened("h1", 46), opened("y", 90), opened("z", 91), opened("h1", 92), opened("h1", 1)]
    for i, row in enumerate(steps):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        out = streams.stream_pr_queue(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    got = [r.head for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    # h1 is kept alive by the events of days 20 and 46, gone by day 90, new on day 92; the event of day 1 is late
    assert sorted(got) == ["h1", "h1", "x", "y", "z"]
