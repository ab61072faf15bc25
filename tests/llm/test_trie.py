import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lattice.llm import trie
from lattice.llm.queries import op11_prefix_trie, rebuilt

KIND = "conv_id long, turn long, role string, text string, pos int, h1 string"


def paths_of(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in by.items()}


def rebuild(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = paths.get(c - c % 20, [])[:h] + own[h:]
    return out


def nodes_of(paths):
    members, ends = {}, {}
    for c, p in paths.items():
        ends.setdefault(tuple(p), []).append(c)
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        saved, leaves, stack = 0, 0, [p]
        while stack:
            q = stack.pop()
            saved += (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
            leaves += q not in kids
            stack += kids.get(q, [])
        return leaves, saved

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below(p), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND)


def found(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


ODD = [
    (1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (2, 0, "user", "a b"), (2, 0, "user", "a b"), (2, None, "", ""), (3, 5, "user", " \t"),
    (20, 0, "user", "x\x0by"), (20, 1, "assistant", "ok"), (21, 0, "user", "one"), (22, 0, "user", "x\x0by"), (23, 9, "u", "z"), (40, 0, "user", "long " * 50_000), (41, 0, "user", "q"),
    (-5, 0, "user", "a b"), (None, 0, "user", "nobody"), (101, 0, "user", "gone with its base"),
]


def some(seed, convs, turns, texts):
    rnd, rows = random.Random(seed), []
    for c in range(convs):
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(texts)) for t in range(rnd.randint(0, turns))]
    return rows


def test_odd_rows(spark):
    assert found(trie.prefix_trie(rebuilt(table(spark, ODD)))) == nodes_of(rebuild(paths_of(ODD)))
    assert found(trie.prefix_trie(trie.placed(table(spark, ODD)))) == nodes_of(paths_of(ODD))
    assert found(trie.prefix_trie(rebuilt(table(spark, ODD).limit(0)))) == []


@pytest.mark.parametrize("slots, paths", [(1, 4), (40, 4), (300, 8)])
def test_shards_merge_in_rounds(spark, slots, paths):
    rows = some(slots, 400, 6, ["a", "b", "c d"]) + [(1000 + c, t, "user", "same") for c in range(60) for t in range(3)] + [(2000, t, "user", str(t % 3)) for t in range(500)] + [(2001, t, "user", str(t % 3)) for t in range(499)]
    assert found(trie.prefix_trie(trie.placed(table(spark, rows)), slots, paths)) == nodes_of(paths_of(rows))


def test_digest_in_pieces(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(9000)]
    got = found(trie.prefix_trie(trie.placed(table(spark, rows))))
    assert got == nodes_of(paths_of(rows)) and len(got) == 2


def test_double_array():
    rnd = np.random.default_rng(1)
    lists = [rnd.integers(1, 50, rnd.integers(0, 6)) for _ in range(500)] + [np.array([i]) for i in range(1, 300, 7)]
    base, check = trie.pack(lists)
    slot_of, path_of = {(): 0}, {0: ()}
    for x in lists:
        at = 0
        for i, c in enumerate(x):
            to = base[at] + c
            assert check[to] == at  # no slot has two parents
            assert slot_of.setdefault(tuple(x[: i + 1]), to) == to and path_of.setdefault(to, tuple(x[: i + 1])) == tuple(x[: i + 1])
            at = to
    assert (check >= 0).sum() == len(path_of) - 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_prefix_trie(spark, sf)) == nodes_of(rebuild(paths_of(rows)))
