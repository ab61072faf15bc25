import hashlib
import random

import pytest
import re

from pyspark.sql import functions as F

from lattice.llm import spotsigs as S
from lattice.llm.queries import op3_spotsigs


def sigs(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    content = [w for w in words if w not in S.ANCHORS]
    out, before = set(), 0
    for w in words:
        if w in S.ANCHORS:
            if before + S.CHAIN <= len(content):
                out.add((w, *content[before : before + S.CHAIN]))
        else:
            before += 1
    return out or {("whole", text)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(sigs(t), sigs(e)), 9), round(jaccard(sigs(t), sigs(nxt)), 9))
    return out


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op3_spotsigs(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == brute(rows)
    prints = {}
    for r in got:
        prints.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_odd_rows(spark):
    from lattice.llm.queries import spot_digest

    rows = [(5, None), (4, ""), (3, "the quick fox and the lazy dog"), (2, "\U0001f600é the a of end"), (1, "The quick fox " * 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, next string")
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in spot_digest(df).collect()} == brute(rows)
    twice = spot_digest(df.unionByName(df).unionByName(spark.createDataFrame([(None, "null id", 1, "x")], df.schema)))
    assert twice.count() == 11 and twice.filter("near_next is null").count() == 0
    assert spot_digest(df.limit(0)).count() == 0


def test_next_over_many_buckets(spark):
    rows = [(i * 3, f"text {i}") for i in range(500)]
    got = {r.id: r.next_text for r in S.with_next(spark.createDataFrame(rows, "doc_id long, text string"), buckets=16).collect()}
    assert got == {i * 3: f"text {(i - 1) % 500}" for i in range(500)}


def test_next_of_text_ids(spark):
    rows = [(f"id{i:03}", f"text {i}") for i in range(100)]
    for buckets in (1, 7, 300):
        got = {r.id: r.next_text for r in S.with_next(spark.createDataFrame(rows, "doc_id string, text string"), buckets=buckets).collect()}
        assert got == {f"id{i:03}": f"text {(i - 1) % 100}" for i in range(100)}


def test_mixed_buckets_in_blocks(spark, monkeypatch):
    """Sets that share rare signatures with a leader that is like few of them."""
    monkeypatch.setattr(S, "BLOCK", 3)
    rnd, rows = random.Random(7), []
    core = [f"c{i}" for i in range(40)]
    for g in range(4):
        own = core + [f"g{g}x{i}" for i in range(14 + 2 * g)]
        for _ in range(9):
            text = [w for w in own if rnd.random() > 0.04]
            rows.append((len(rows), " ".join(f"the {w} q{w}" for w in text)))
    rnd.shuffle(rows)
    sets, parent = [(i, sigs(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and jaccard(a, b) >= 0.75:
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    assert 1 < len({root(i) for i, _ in rows}) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == {i: root(i) for i, _ in rows}


@pytest.mark.parametrize("least", [0.75, 0.55, 0.5])
def test_near_duplicates_against_brute_force(spark, least):
    rnd, rows = random.Random(2), []
    words = [f"w{i}" for i in range(200)] + S.ANCHORS[:30] * 4
    for _ in range(20):
        base = [rnd.choice(words) for _ in range(rnd.choice([5, 60, 150]))]
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, "")]
    sets, parent = [(i, sigs(t or "")) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and jaccard(a, b) >= least:
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df, least).collect()} == {i: root(i) for i, _ in rows}


def test_hash_of_words(spark):
    t = spark.createDataFrame([("Über_die  Brücke, naïve!",)], "t string").select(S.words_of(F.col("t"))).first()[0]
    assert t == ["über", "die", "brücke", "naïve"]
