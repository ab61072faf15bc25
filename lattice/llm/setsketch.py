"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles (64-bit hashes). For each of M registers the least of M independent
hashes of the set is an exponential minimum; the register holds it on an exponential scale, truncated to 0..Q+1:
K = floor(1 - log_b(minimum / a)). Registers of a union are the greater of both registers, so sketches merge, and equal
registers are about as likely as the sets are similar. Bands of ROWS registers are hashed to buckets. A pair from a
bucket is estimated from its counts of greater, smaller and equal registers by maximum likelihood with the known set
sizes, and what may reach the threshold is verified on the full sets.

A pair at the threshold of 0.75 shares no band with a chance of (1 - 0.75^4)^32 = 5e-6; the estimate, from 1024 registers,
lets everything within 4.5 standard deviations of the threshold through (a miss of 3e-6).

A bucket never yields all its pairs. First its members meet its least id only. Buckets that are then in one component
are done. In the others, members of different components are compared by their registers inside tasks (large buckets
in pairs of blocks, so no task holds a bucket, and none of two blocks of the largest component), a pair only in the
first band that it shares: first each member's three
likeliest partners are verified, then everything that the estimate leaves open between the components that remain. No
bucket or partner is capped.

Defined cases: null or empty text, or text without words, has n_shingles 0 and is alone; fewer words than a shingle make
one shingle of them all; equal sets are linked (by a 128-bit hash of the whole set) before anything else; rows that
repeat an id count as one document; a null id is linked with nothing, has a null component and is kept. An empty table
gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import bucketed, connected_components, written

BANDS, ROWS = 32, 4
#: Registers that are banded, and registers that estimate.
BANDED, M = BANDS * ROWS, 1024
#: The scale of the registers that estimate: base, rate and greatest value less one; they are bytes.
BASE, RATE, Q = 1.1, 20.0, 254
#: Base and greatest value less one of the banded registers, of two bytes: so fine that unlike sets hardly share a value.
FINE, FINE_Q = 1.001, 65534
#: Standard deviations below the threshold from which an estimate is verified, and rows of a block.
MARGIN, BLOCK = 4.5, 512

_RNG = np.random.default_rng(20240501)
_MULTIPLY = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_HIGH, _LOW, _ADD = (_RNG.integers(0, 2**32, M, dtype=np.uint32) | np.uint32(1) for _ in range(3))


class _Words(dict):
    """Word to 64-bit hash; starts afresh when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text. bytes.lower and bytes.split take A-Z and ASCII space only."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h + w[j : len(w) - k + 1 + j]) * _MULTIPLY[j % 16] ^ (h >> np.uint64(29))
    return np.unique(_mixed(h))


def registers(h: np.ndarray, m: int = M, fine: bool = False) -> np.ndarray:
    low, high = h.astype(np.uint32)[:, None], (h >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(m, 2**32 - 1, np.uint32)
    for s in range(0, len(h), 512):
        x = high[s : s + 512] * _HIGH[:m]
        x += low[s : s + 512] * _LOW[:m]
        x += _ADD[:m]
        np.minimum(least, x.min(axis=0), out=least)
    minimum = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    base, q, kind = (FINE, FINE_Q, np.uint16) if fine else (BASE, Q, np.uint8)
    return np.clip(np.floor(1 - np.log(minimum) / math.log(base)), 0, q + 1).astype(kind)


def text_hash(text: Column) -> Column:
    """Tells rows that repeat an id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int = 5) -> DataFrame:
    """(id, text_hash, n_shingles, h1, h2, registers): h1, h2 hash the whole set; the banded registers, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            n, one, two, regs = [], [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), size, words)
                digest = xxhash.xxh3_128_digest(h.tobytes())
                n.append(len(h))
                one.append(int.from_bytes(digest[:8], "big", signed=True))
                two.append(int.from_bytes(digest[8:], "big", signed=True))
                regs.append(registers(h, BANDED, fine=True).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())], ["id", "text_hash", "n_shingles", "h1", "h2", "registers"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), text_hash(F.col(text_col)).alias("text_hash"))
    return rows.mapInArrow(run, f"id {rows.schema[0].dataType.simpleString()}, text_hash long, n_shingles long, h1 long, h2 long, registers binary")


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(id, shingles array<long>, registers, banded) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                sets = [shingles(t.as_py(), size, words) for t in part.column(1)]
                regs, banded = [registers(h).tobytes() for h in sets], [registers(h, BANDED, fine=True).tobytes() for h in sets]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64), pa.int64())), pa.array(regs, pa.binary()), pa.array(banded, pa.binary())], ["id", "shingles", "registers", "banded"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, shingles array<long>, registers binary, banded binary")


def estimated(greater: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = M) -> np.ndarray:
    """The similarity of greatest likelihood, given how many registers of a are greater or smaller than those of b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return greater * np.log(up) + smaller * np.log(down) + (m - greater - smaller) * np.log(np.clip(1 - up - down, 1e-9, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        one, two = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(one) > likelihood(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def _cutoff(percent: int) -> float:
    share = percent / 100
    return share - MARGIN * math.sqrt(share * (1 - share) / M)


def _estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return estimated((a > b).sum(1), (a < b).sum(1), na.astype(float), nb.astype(float))


def _registers_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, M)


@F.pandas_udf(T.DoubleType())
def _estimate(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series(_estimates(_registers_of(ra), _registers_of(rb), na.to_numpy(), nb.to_numpy()))


def links(pairs: DataFrame, full: DataFrame, percent: int, estimate: bool = False) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union; full is (id, n, shingles, registers)."""
    if estimate:
        side = lambda x: full.select(F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = pairs.filter(_estimate("ra", "rb", "na", "nb") >= _cutoff(percent)).select("a", "b")
    whole = lambda x: full.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _block_pairs(rows: pd.DataFrame, percent: int, best: int | None) -> pd.DataFrame | None:
    """Pairs of one group (a block of a bucket, or two) to verify: of different parts, in the first band that both share,
    of a sufficient estimate; with best, only the so many likeliest of each row."""
    n, part, side, rep = rows["n"].to_numpy(), rows["part"].to_numpy(), rows["side"].to_numpy(), rows["rep"].to_numpy()
    regs = _registers_of(rows["registers"])
    band = np.frombuffer(b"".join(rows["banded"]), np.uint16).view(np.uint64).reshape(-1, BANDS)  # four registers of 16 bits
    t, left, right = int(rows["band"].iloc[0]), [], []
    for i in range(len(rows)):
        j = np.arange(i + 1, len(rows)) if not side.any() else np.flatnonzero(side > side[i])
        j = j[(part[j] != part[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        j = j[~(band[j, :t] == band[i, :t]).any(axis=1)]
        left.append(np.full(len(j), i))
        right.append(j)
    a, b = np.concatenate(left), np.concatenate(right)
    e = np.concatenate([_estimates(regs[x], regs[y], n[x], n[y]) for x, y in ((a[s : s + 4096], b[s : s + 4096]) for s in range(0, max(1, len(a)), 4096))])
    fine = e >= _cutoff(percent)
    a, b, e = a[fine], b[fine], e[fine]
    if not len(a):
        return None
    if best is not None:
        both = pd.DataFrame({"x": np.concatenate([a, b]), "k": np.tile(np.arange(len(a)), 2), "e": np.tile(e, 2)}).sort_values("e", ascending=False, kind="stable")
        keep = np.unique(both.groupby("x").head(best)["k"])
        a, b = a[keep], b[keep]
    x, y = rep[a], rep[b]
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _compare(groups: DataFrame, percent: int, best: int | None) -> DataFrame:
    """groups is sorted by bucket, bi, bj within its partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["bucket", "bi", "bj"]].to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)]
            found = [x for s, e in zip(starts, starts[1:]) if e - s > 1 and (x := _block_pairs(pdf.iloc[s:e], percent, best)) is not None]
            rest = pdf.iloc[starts[-1] :].reset_index(drop=True)
            if found:
                yield pd.concat(found, ignore_index=True)
        if rest is not None and len(rest) > 1 and (x := _block_pairs(rest, percent, best)) is not None:
            yield x

    kind = groups.schema["rep"].dataType.simpleString()
    return groups.mapInPandas(run, f"a {kind}, b {kind}")


def _cross_pairs(live: DataFrame, parts: DataFrame, full: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs to verify from the buckets whose members are in several parts, each bucket dealt into pairs of blocks. Two of
    the largest part never need to meet, so its members are copied for the blocks of the others only."""
    placed = live.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "band", "rep", F.coalesce("component_id", "rep").alias("part"))
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
    mixed = sizes.agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("part", F.struct("c", "part")).alias("main")).filter("size > most")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = written(mixed.select("bucket", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("size") - F.col("most")).alias("others")), "mixed")
    # the blocks of the largest part come first; they meet the others, and these meet all
    rows, ours = placed.join(mixed, "bucket"), F.col("part") == F.col("main")
    rows = rows.withColumn("own", F.when(ours, F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("rep"), F.col("others"))).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.when(ours, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    rows = rows.join(full.select(F.col("id").alias("rep"), "n", "registers", "banded"), "rep")
    rows = rows.select("bucket", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "band", "rep", "part", "n", "registers", "banded")
    return _compare(rows.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj"), percent, best).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, text_hash: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs, and the row's text_hash if asked for."""
    sketches = written(sketch(docs, id_col, text_col, size), "sketches")
    known = sketches.filter(F.col("registers").isNotNull() & F.col("id").isNotNull())
    sets = written(known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "sets")

    code = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    buckets = sets.select(F.posexplode(code).alias("band", "bucket"), "rep")
    # written, so that Spark can split the join where a bucket is hot
    many = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("leader")).filter("size > 1"), "many")
    live = written(buckets.join(many, "bucket"), "buckets")
    ids = live.select(F.col("rep").alias("id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")
    table = bucketed(shingle_sets(texts, size).withColumn("n", F.size("shingles").cast("long")), "id", "shingles")
    full = docs.sparkSession.table(table)

    try:
        star = live.filter("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
        edges = written(links(star, full, percent, estimate=True), "links")
        parts = connected_components(edges)
        live = live.filter("size > 2 and rep != leader")
        for best in (3, None):
            more = written(links(_cross_pairs(live, parts, full, percent, best), full, percent), "links")
            if not more.isEmpty():
                edges = edges.unionByName(more)
                parts = connected_components(edges)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")

    place = known.groupBy("h1", "h2").agg(F.min("id").alias("rep")).join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    place = place.select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id"))
    out = sketches.select("id", "text_hash", "n_shingles", *(F.when(F.col("registers").isNotNull() & F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("h1", "h2")))
    out = out.join(place, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *(["text_hash"] if text_hash else []))
