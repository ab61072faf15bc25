"""Conversations as a prefix trie, packed as double arrays.

A conversation is its list of turns (role, text). Each distinct list of first turns is a node; the empty list is the root.
Conversations with equal turns are one path with a count and their least id. The paths, sorted, are dealt to shards: a
shard is a range of prefixes, cut by size, so a first turn that a third of all conversations share fills many shards and
not one. In a shard the turns get dense numbers (alike turns alike), and the trie goes into two arrays: the child of slot
s by turn c is slot BASE[s] + c, if CHECK of that slot is s. All paths of the shard walk the arrays together and leave
their counts; sums go up by CHECK.

A node that lies on neither the first nor the last path of its shard is known whole there and is put out. The others, the
upper nodes that neighbouring shards may share, go on as two paths a shard that carry what was gathered for each node on
them; these paths are sorted and dealt to shards again, round by round, until one shard holds what is left. A round
leaves two paths of each shard of SLOTS turns, so a few rounds do at any size, and no node waits in the driver.

A digest of the ids that end at a node is a SHA-256, which must be fed in order: ids are sorted, put together to pieces
within sorted partitions, and one task feeds the pieces of a node, as they come, into its digest.

Defined cases: a null role or text is empty; turns go by turn (null first), then role and text, and repeated rows are
repeated turns; rows without an id belong to no conversation and are left out; a conversation may be without turns, then
it is a member of the root only; an empty table has no node; only the named columns are read. A path is one row (24 bytes
a turn), a shard at least one path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.common import written

#: Turns that a shard holds (more where PATHS paths are longer), paths that it holds at least, and ids of a piece of a digest.
SLOTS, PATHS, PIECE = 1 << 17, 16, 4096
WORD = r"[^\x20\x09-\x0D]+"
_SUMS, _IDS = ("convs", "kids", "leaves", "saved"), ("least", "ends")
_PATH = "a array<bigint>, b array<bigint>, words array<bigint>, convs array<bigint>, least array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<bigint>"
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends bigint, name binary, parent_name binary"
_NONE = np.iinfo(np.int64).max


def placed(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, role, text): the turns of each conversation numbered from 1."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.filter("conv is not null").withColumn("pos", F.row_number().over(order)).select("conv", "pos", "role", "text")


def _place(taken: np.ndarray, low: int, offsets: np.ndarray) -> int:
    """The first free slot, from low on, whose neighbours at the offsets are free or past the end."""
    wide = 64
    while True:
        spots = low + np.flatnonzero(~taken[low : low + wide])
        if low + wide > len(taken):
            spots = np.append(spots, len(taken))
        for s in range(0, len(spots), max(1, 1 << 16 // len(offsets))):
            at = spots[s : s + max(1, 1 << 16 // len(offsets)), None] + offsets
            good = np.flatnonzero(~(taken[np.minimum(at, len(taken) - 1)] & (at < len(taken))).any(axis=1))
            if len(good):
                return int(at[good[0], 0])
        low, wide = low + wide, 4 * wide


def pack(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base, check) of a double array that holds lists of codes from 1 on. The root is slot 0; CHECK is -1 at a free slot
    and at the root. The children of a node go where all of them find free slots first."""
    lens = np.array([len(x) for x in lists])
    room = 2 * int(lens.sum()) + 2
    base, check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
    taken = np.zeros(room, bool)
    taken[0] = True
    at, low = np.zeros(len(lists), np.int64), 1  # every slot below low is taken
    for d in range(int(lens.max(initial=0))):
        on = np.flatnonzero(lens > d)
        turn = np.fromiter((lists[i][d] for i in on), np.int64, len(on))
        slot = at[on]
        edges = np.unique(np.stack([slot, turn], axis=1), axis=0)
        cuts = np.flatnonzero(np.diff(edges[:, 0], prepend=-1))
        for i, j in zip(cuts, np.append(cuts[1:], len(edges))):
            c = edges[i:j, 1]
            while low < len(taken) and taken[low]:
                low += 1
            kids = _place(taken, low, c - c[0]) + c - c[0]
            if kids[-1] >= len(taken):
                more = int(kids[-1]) + 1 - len(taken) + len(taken) // 2
                base, check, taken = np.append(base, np.zeros(more, np.int64)), np.append(check, np.full(more, -1)), np.append(taken, np.zeros(more, bool))
            base[edges[i, 0]] = kids[0] - c[0]  # may be negative
            taken[kids], check[kids] = True, edges[i, 0]
        at[on] = base[slot] + turn
    return base, check


def _names(a: list[int], b: list[int]) -> list[bytes]:
    """A 128-bit name of each prefix, the empty one first."""
    digest = hashlib.blake2b(digest_size=16)
    out = [digest.digest()]
    for x in np.stack([np.asarray(a, np.int64), np.asarray(b, np.int64)], axis=1):
        digest.update(x.tobytes())
        out.append(digest.digest())
    return out


def shard_nodes(rows: list[dict], last: bool) -> tuple[dict[str, list], list[dict]]:
    """The nodes of sorted paths that are known whole, as columns, and the paths that go on; in the last shard of all
    every node is known whole."""
    lens = np.array([len(r["a"]) for r in rows])
    cut = np.append(0, np.cumsum(lens))
    pairs = np.stack([np.concatenate([np.asarray(r[k], np.int64) for r in rows]) for k in "ab"], axis=1)
    dense = np.unique(pairs, axis=0, return_inverse=True)[1].reshape(-1) + 1 if len(pairs) else np.empty(0, np.int64)
    words = np.concatenate([np.asarray(r["words"], np.int64) for r in rows])
    lists = [dense[i:j] for i, j in zip(cut[:-1], cut[1:])]
    base, check = pack(lists)
    total = {k: np.zeros(len(base), np.int64) for k in (*_SUMS, "word", "depth")} | {k: np.full(len(base), _NONE) for k in _IDS}
    bare = np.array([r["convs"] is None for r in rows])
    edge = [] if last else sorted({0, len(rows) - 1})
    paths: dict[int, list[int]] = {i: [] for i in edge}
    names: dict[int, bytes] = {}
    at = np.zeros(len(rows), np.int64)
    for d in range(int(lens.max(initial=0)) + 1):  # all paths walk the arrays together
        on = np.flatnonzero(lens >= d)
        if d:
            to = base[at[on]] + np.fromiter((lists[i][d - 1] for i in on), np.int64, len(on))
            if not (check[to] == at[on]).all():
                raise AssertionError("a path left the trie")
            at[on], total["depth"][to] = to, d
            total["word"][to] = words[cut[on] + d - 1]
        for i in edge:
            if lens[i] >= d:
                paths[i].append(int(at[i]))
        old = on[~bare[on]]  # what an earlier round gathered for the nodes of these paths
        for k in _SUMS:
            np.add.at(total[k], at[old], np.array([rows[i][k][d] for i in old], np.int64))
        for k in _IDS:
            np.minimum.at(total[k], at[old], np.array([_NONE if rows[i][k][d] is None else rows[i][k][d] for i in old], np.int64))
        own = on[bare[on] & (lens[on] == d)]
        np.add.at(total["convs"], at[own], np.array([rows[i]["n"] for i in own], np.int64))
        for k in _IDS:
            np.minimum.at(total[k], at[own], np.array([rows[i]["id"] for i in own], np.int64))
    open_ = np.zeros(len(base), bool)
    for i in edge:
        open_[paths[i]] = True
        names |= dict(zip(paths[i], _names(rows[i]["a"], rows[i]["b"])))
    used = np.append(0, np.flatnonzero(check >= 0))
    used = used[np.argsort(-total["depth"][used], kind="stable")]
    cuts = np.flatnonzero(np.diff(total["depth"][used], prepend=-1))
    for i, j in zip(cuts, np.append(cuts[1:], len(used))):  # sums go up from the deepest nodes
        s = used[i:j][~open_[used[i:j]]]
        total["leaves"][s] += total["kids"][s] == 0
        total["saved"][s] += (total["convs"][s] - 1) * total["word"][s]
        s = s[check[s] >= 0]
        up = check[s]
        for k in ("convs", "leaves", "saved"):
            np.add.at(total[k], up, total[k][s])
        np.add.at(total["kids"], up, 1)
        np.minimum.at(total["least"], up, total["least"][s])
    done = used[~open_[used]]
    if not bare.all():  # later rounds hold nodes that children of earlier rounds wait for
        walked = {}
        for r, codes in zip(rows, lists):
            slots = [0]
            for c in codes:
                slots.append(int(base[slots[-1]] + c))
            walked |= dict(zip(slots, _names(r["a"], r["b"])))
        names |= walked
    waits = (check[done] >= 0) & open_[check[done]]
    nodes = {
        "conv_id": total["least"][done].tolist(), "depth": total["depth"][done].tolist(),
        "parent_conv_id": [None if w or u < 0 else int(total["least"][u]) for w, u in zip(waits, check[done])],
        "n_convs": total["convs"][done].tolist(), "n_children": total["kids"][done].tolist(), "n_leaves": total["leaves"][done].tolist(), "saved_tokens": total["saved"][done].tolist(),
        "ends": [None if x == _NONE else x for x in total["ends"][done].tolist()],
        "name": [None] * len(done) if bare.all() else [names[s] for s in done.tolist()],
        "parent_name": [names[u] if w else None for w, u in zip(waits, check[done].tolist())],
    }
    going, seen = [], set()
    for i in edge:  # a node on both paths goes with the first
        row = {k: list(rows[i][k]) for k in ("a", "b", "words")}
        for k in (*_SUMS, *_IDS):
            none = 0 if k in _SUMS else _NONE
            row[k] = [None if x == _NONE else x for x in (none if s in seen else int(total[k][s]) for s in paths[i])]
        seen.update(paths[i])
        going.append(row)
    return nodes, going


_TYPES = {"name": pa.binary(), "parent_name": pa.binary()}


def _round(paths: DataFrame, parts: int, last: bool, slots: int, least: int) -> DataFrame:
    """(node, path): what the shards of sorted paths put out, and what goes on."""
    key = F.arrays_zip("a", "b")
    rows = (paths.coalesce(1) if last else paths.repartitionByRange(parts, key)).sortWithinPartitions(key)
    node_names = [f.split()[0] for f in _NODE.split(", ")]
    path_names = [f.split()[0] for f in _PATH.split(", ")]

    def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        nodes, going = shard_nodes(rows, last)
        n = len(nodes["conv_id"])
        for s in range(0, n, 1 << 16):
            node = pa.StructArray.from_arrays([pa.array(nodes[k][s : s + (1 << 16)], _TYPES.get(k, pa.int64())) for k in node_names], node_names)
            yield pa.RecordBatch.from_arrays([node, pa.nulls(len(node), pa.struct([(k, pa.list_(pa.int64())) for k in path_names]))], ["node", "path"])
        if going:
            path = pa.StructArray.from_arrays([pa.array([r[k] for r in going], pa.list_(pa.int64())) for k in path_names], path_names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(path), pa.struct([(k, _TYPES.get(k, pa.int64())) for k in node_names])), path], ["node", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["a"]) + 1
                if size >= slots and len(held) >= least and not last:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return written(rows.mapInArrow(run, f"node struct<{_struct(_NODE)}>, path struct<{_struct(_PATH)}>"), "trie")


def _struct(fields: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in fields.split(", "))


def _id_digests(convs: DataFrame) -> DataFrame:
    """(h1, h2, id, n, sha): least id and number of the ids of each (h1, h2), and the digest of all, ascending, joined by
    commas. convs: (h1, h2, conv)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], len(ids), ",".join(map(str, ids)))], ["h1", "h2", "id", "n", "ids"])

        for batch in batches:
            for h1, h2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (key != (h1, h2) or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = (h1, h2)
                ids.append(conv)
        if ids:
            yield piece()

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *state[:2], state[2].hexdigest())], ["h1", "h2", "id", "n", "sha"])

        for batch in batches:
            for h1, h2, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (h1, h2):
                    if key:
                        yield made()
                    key, state = (h1, h2), [first, 0, hashlib.sha256()]
                state[2].update((("," if state[1] else "") + ids).encode())
                state[1] += n
        if key:
            yield made()

    rows = convs.repartitionByRange("h1", "h2", "conv").sortWithinPartitions("h1", "h2", "conv")
    pieces = rows.mapInArrow(cut, "h1 bigint, h2 bigint, id bigint, n bigint, ids string")
    return pieces.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id").mapInArrow(feed, "h1 bigint, h2 bigint, id bigint, n bigint, sha string")


def prefix_trie(rows: DataFrame, shard_slots: int = SLOTS, shard_paths: int = PATHS) -> DataFrame:
    """Nodes of the trie of conversations: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words of turns that need not be kept again, over the subtree), ends_sha256.

    rows: (conv, pos, role, text), one for each turn, in the order of pos; a row with a null pos names a conversation and
    adds no turn. A shard holds shard_paths paths at least (4 or more, as two go on), and more up to shard_slots turns."""
    if shard_paths < 4:
        raise ValueError("a shard holds 4 paths at least")
    spark = rows.sparkSession
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", F.lit(17), "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("w")))
    lists = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    paths = lists.select("conv", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.w").alias("words"))
    paths = written(paths.withColumns({"h1": F.xxhash64("a", "b"), "h2": F.xxhash64("b", F.lit(17), "a")}), "paths")
    ids = written(_id_digests(paths.select("h1", "h2", "conv")), "ids")
    todo = paths.join(ids.select(F.col("id").alias("conv"), "id", "n"), "conv").select("a", "b", "words", "n", "id", *(F.lit(None).cast("array<bigint>").alias(k) for k in (*_SUMS, *_IDS)))
    todo = written(todo, "level")
    found: list[DataFrame] = []
    while True:
        n, slots = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("a") + 1), F.lit(0))).first()
        if not n:
            break
        last = n <= shard_paths or slots <= shard_slots
        parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-slots // shard_slots), n // shard_paths + 1)
        made = _round(todo, parts, last, shard_slots, shard_paths)
        found.append(made.filter("node is not null").select("node.*"))
        if last:
            break
        todo = made.filter("path is not null").select("path.*").select("a", "b", "words", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("id"), *_SUMS, *_IDS)
    if not found:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = found[0]
    if len(found) > 1:  # nodes whose parent was still open when they were put out
        later = found[1]
        for more in found[2:]:
            later = later.unionByName(more)
        known = later.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("_parent"))
        nodes = nodes.unionByName(later)
        nodes = nodes.filter("parent_name is null").unionByName(nodes.filter("parent_name is not null").join(known, "parent_name").withColumn("parent_conv_id", F.col("_parent")).select(*nodes.columns))
    out = nodes.join(ids.select(F.col("id").alias("ends"), "sha"), "ends", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
