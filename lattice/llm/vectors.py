"""Near-duplicate vectors by cosine.

Random-hyperplane signs give each vector a code in each of several tables; vectors that share a code in a table are
compared by exact cosine in double precision. Two vectors at a cosine of 0.95 (18.2 degrees) agree on a sign with a
chance of 0.899. The signs of a code grow with the logarithm of the number n of vectors (log2 n + SPARE), so chance
meetings grow in proportion to n, and the number of tables follows from the signs: a pair at the threshold misses in all
tables with a chance of MISS at most, whatever n is; closer pairs are missed less often. (50,000 vectors: 20 signs, 101
tables; a million times as many: 40 signs, 900 tables.)

Equal vectors are one vector with a count. The rows of a bucket are dealt into blocks of about BLOCK rows, and each pair
of blocks is one group, so a bucket of any size is spread over tasks, and no pair is ever a row: a task adds up links
per vector and joins its linked vectors under its own local roots. A pair that shares several buckets is counted in the
first table it shares only; the codes of the tables before travel with the vector to tell.

Defined cases: a vector that is null, zero, or holds a null or non-finite component has no links and is its own
component; vectors of different lengths are not compared; components of any finite size count (they are scaled before
they are squared); rows that repeat an id with equal vectors count as further vectors; a null id has no links, a null
component and is kept. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import connected_components, written

#: Signs beyond log2 of the number of vectors, and the chance that a pair at the threshold shares no code.
SPARE, MISS = 4, 3e-6
#: Rows of a block; groups up to so many rows are compared many at once.
BLOCK, SMALL = 1024, 16


def scheme(n: int, least: float) -> tuple[int, int]:
    """(tables, signs of a code) for n vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) + SPARE)
    agree = 1 - math.acos(least) / math.pi
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(agree**bits)))) if agree < 1 else 1, bits


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def codes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """int64 code of each unit vector (row) in each table."""
    out = np.empty((len(vectors), tables), np.int64)
    h, weights = np.random.default_rng(vectors.shape[1] * 7919 + 17).standard_normal((vectors.shape[1], tables * bits)), 2.0 ** np.arange(bits)
    for s in range(0, len(vectors), 512):
        out[s : s + 512] = (vectors[s : s + 512] @ h > 0).reshape(-1, tables, bits).astype(np.float64) @ weights
    return out


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column whose values are equally long, as a matrix."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1) if data else np.empty((len(column), 0), kind)


def _with_codes(distinct: DataFrame, tables: int, bits: int) -> DataFrame:
    """(rep, copies, dim, vec, codes, packed): vec is the unit vector's doubles, packed are the codes' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(2).value_lengths())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for s in range(0, len(at), 1000):
                    p = batch.take(pa.array(at[s : s + 1000]))
                    v = unit(p.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    c = codes(v, tables, bits)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * tables, pa.int32()), pa.array(c.ravel()))
                    yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(np.full(len(c), dim), pa.int32()), pa.array([x.tobytes() for x in v], pa.binary()), lists, pa.array([x.tobytes() for x in c], pa.binary())], ["rep", "copies", "dim", "vec", "codes", "packed"])

    kind = distinct.schema["rep"].dataType.simpleString()
    return distinct.mapInArrow(run, f"rep {kind}, copies long, dim int, vec binary, codes array<long>, packed binary")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches over the links a, b (given in both directions)."""
    root = np.arange(n)
    while len(a):  # least label over neighbours, then jump
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _links(unit_rows: np.ndarray, code: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float):
    """(a, b, first): linked rows of the groups starts..ends of one table, each pair once, and whether no earlier table
    has them together. side is all zero in a block with itself, 0 and 1 in two blocks, of which only mixed pairs count."""
    found, size = [], ends - starts
    group = np.repeat(np.arange(len(starts)), size)
    small = np.concatenate([np.arange(s, e) for s, e in zip(starts[size <= SMALL], ends[size <= SMALL])] or [np.empty(0, np.int64)]).astype(np.int64)
    group_of = np.full(len(unit_rows), -1)
    group_of[np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]).astype(np.int64)] = group
    for k in range(1, SMALL):  # pairs k rows apart, of all small groups at once
        a = small[small + k < len(unit_rows)]
        a = a[group_of[a] == group_of[a + k]]
        if not len(a):
            break
        for s in range(0, len(a), 50_000):
            x = a[s : s + 50_000]
            x = x[np.einsum("ij,ij->i", unit_rows[x], unit_rows[x + k]) >= least]
            found.append((x, x + k))
    for s, e in zip(starts[size > SMALL], ends[size > SMALL]):
        a, b = np.nonzero(np.triu(unit_rows[s:e] @ unit_rows[s:e].T >= least, 1))
        found.append((a + s, b + s))
    a, b = (np.concatenate([x[i] for x in found] or [np.empty(0, np.int64)]) for i in (0, 1))
    # two blocks hold rows of both sides
    two = np.zeros(len(starts), bool)
    np.logical_or.at(two, group, side[np.concatenate([np.arange(s, e) for s, e in zip(starts, ends)]).astype(np.int64)] > 0)
    mixed = ~two[group_of[a]] | (side[a] != side[b])
    a, b = a[mixed], b[mixed]
    first = np.ones(len(a), bool)
    for s in range(0, len(a), 50_000):
        cut = slice(s, s + 50_000)
        first[cut] = ~(code[a[cut]] == code[b[cut]]).any(axis=1)
    return a, b, first


def _compare(groups: DataFrame, least: float, kind: str) -> DataFrame:
    """(rep, n_links, other): links counted for rep, and a vector of its component (or null). groups is sorted by its first
    five columns, which name a group."""

    def done(t: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        """starts, ends: groups of one dim and table, of two rows or more."""
        v, code, side, copies = _rows(t.column(8), np.float64), _rows(t.column(9), np.int64), t.column(5).to_numpy(), t.column(7).to_numpy()
        a, b, first = _links(v, code, side, starts, ends, least)
        if not len(a):
            return None
        n, x, y = len(v), np.concatenate([a, b]), np.concatenate([b, a])
        fresh = np.concatenate([first, first])
        counts = np.bincount(x[fresh], weights=copies[y[fresh]], minlength=n).astype(np.int64)
        root = _roots(n, x, y)
        keep = np.flatnonzero((counts > 0) | (root != np.arange(n)))
        rep = t.column(6)
        return pa.RecordBatch.from_arrays([rep.take(pa.array(keep)), pa.array(counts[keep]), rep.take(pa.array(root[keep]))], ["rep", "n_links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_end(batches):
            t = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
            if t is None or not t.num_rows:
                continue
            key = np.stack([t.column(i).to_numpy() for i in range(5)], axis=1)
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            if batch is not None:  # the last group may go on
                rest = t.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            wide = ends - starts > 1
            starts, ends = starts[wide], ends[wide]
            kinds = key[starts, :2]
            turn = np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *turn], [*turn, len(starts)]):
                if e > s:
                    at = starts[s]
                    out = done(t.slice(at, ends[e - 1] - at), starts[s:e] - at, ends[s:e] - at)
                    if out is not None:
                        yield out

    return groups.mapInArrow(run, T.StructType([T.StructField("rep", kind), T.StructField("n_links", T.LongType()), T.StructField("other", kind)]))


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of df; links are pairs of cosine >= least."""
    v = F.col(vec_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("vec"))
    distinct = written(rows.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    coded = written(_with_codes(distinct.select("rep", "copies", "vec"), *scheme(distinct.count(), least)), "codes")

    per_table = coded.select("rep", "dim", F.posexplode("codes").alias("table", "code"))
    many = written(per_table.groupBy("dim", "table", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = per_table.join(many, ["dim", "table", "code"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.join(coded.select("rep", "copies", "vec", "packed"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    before = F.substring("packed", F.lit(1), F.col("table") * 8)  # the codes of the tables before
    groups = dealt.select("dim", "table", "code", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "rep", "copies", "vec", before.alias("before"))
    key = ["dim", "table", "code", "bi", "bj"]
    found = written(_compare(groups.repartition(*key).sortWithinPartitions(*key), least, rows.schema["id"].dataType), "linked")

    parts = connected_components(found.select("rep", "other"), "rep", "other")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    place = distinct.join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    place = place.select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(place, "vec", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
