"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the vocabulary finds, for each position of a piece,
the longest token that starts there. The encoder walks from longest match to longest match; a token is taken only if it
is compatible with the one before it, that is, if merging the bytes of both gives the same two tokens. Compatibility is
memoised per pair. Where none fits it steps back and tries the next shorter prefix; each end position is given up at
most once, so the walk is linear in the piece. A sequence whose neighbours are all compatible is the one that the merges
give.

Rows: null text encodes as the empty text (no ids). Texts are never cut; repeated rows stay repeated; an empty table
gives an empty result; only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces up to this length are remembered, up to so many; then the memory starts afresh.
CACHED_CHARS, CACHED_PIECES = 48, 200_000
#: Characters of text, and ids, that go into one output batch.
BATCH_CHARS = 1_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """Plain merging, lowest rank first and leftmost on ties, down to `least` parts; used for short byte strings only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class _Pieces(dict):
    """Piece to its ids as int32 bytes; remembers short pieces and starts afresh when full."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encoder.encode_bytes(piece.encode())).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        self.length = {}
        for token, rank in ranks.items():
            if merge(token, ranks) == [rank]:  # a token that merging never makes must not be matched inside a piece
                self.automaton.add_word(token.decode("latin-1"), rank)
                self.length[rank] = len(token)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.known = _Pieces(self)

    def _shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.bytes_of[rank]
            cut = (self.ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            found = self.shorter[rank] = next((r for r in cut if r in self.length), -1)
        return found

    def _halves(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; twice itself for a single byte."""
        found = self.halves.get(rank)
        if found is None:
            token = self.bytes_of[rank]
            found = self.halves[rank] = (rank, rank) if len(token) == 1 else tuple(merge(token, self.ranks, 2))
        return found

    def _fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart side by side. Merges are undone across the border, the later one first: the pieces
        that then touch must not merge before the merge that was undone. On equal ranks the left place merges first."""
        found = self.fits.get(a << 32 | b)
        if found is None:
            if len(self.fits) > 200_000:
                self.fits.clear()
            x, y, before = a, b, 1 << 60
            while True:
                joined = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                if joined is not None and joined < before:
                    found = False
                    break
                left, right = self._halves(x)[1], self._halves(y)[0]
                if left == x and right == y:
                    found = True
                    break
                if right == y or (left != x and x > y):
                    x, before = left, x
                else:
                    y, before = right, y + 1
            self.fits[a << 32 | b] = found
        return found

    def encode_bytes(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - self.length[rank]] = rank  # ends only grow, so the last one is the longest
        length, open_, out, at = self.length, bytearray(b"\1") * (len(piece) + 1), [], 0
        token = longest[0] if piece else -1
        while at < len(piece):
            while token >= 0 and not (open_[at + length[token]] and (not out or self._fits(out[-1], token))):
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < len(piece) else -1
            else:
                if not out:
                    return merge(piece, self.ranks)  # no chain of compatible tokens: not a merge-made vocabulary
                open_[at] = 0
                token = out.pop()
                at -= length[token]
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text as int32 bytes."""
        if len(text) < BATCH_CHARS:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        return b"".join(self.known[m[0]] for m in self.pattern.finditer(text))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def _encoder(data: bytes, pattern: str) -> Encoder:
    """One for each worker process, with what it remembers."""
    return Encoder(parse_ranks(data), pattern)


@lru_cache(maxsize=1)
def _table(data: bytes) -> dict[int, bytes]:
    return {r: t for t, r in parse_ranks(data).items()}


def _ranks(df: DataFrame, ranks_path: str):
    """The rank file is read once on the driver and broadcast: its size is that of a vocabulary, whatever the data."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoded(df: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, schema: str, make: Callable) -> DataFrame:
    """One pass over df: make(encoder, packed ids of some rows) gives the columns after id_col. Rows go in slices of about
    BATCH_CHARS ids."""
    ranks = _ranks(df, ranks_path)
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([rows.schema[0], *T.StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            start, size, packed = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                packed.append(encoder.packed(text.as_py() or ""))
                size += len(packed[-1])
                if size > 4 * BATCH_CHARS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(packed)), *make(encoder, packed)], names)
                    start, size, packed = i + 1, 0, []

    names = kind.names
    return rows.mapInArrow(run, kind)


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, packed)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row of df."""
    return _encoded(df, ranks_path, pattern, id_col, text_col, "ids array<int>", lambda encoder, packed: [_lists(packed)])


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary) for every row of df: encode, and decode of what it gave, in one pass."""

    def make(encoder: Encoder, packed: list[bytes]) -> list[pa.Array]:
        return [_lists(packed), pa.array([encoder.decode(np.frombuffer(x, np.int32).tolist()) for x in packed], pa.binary())]

    return _encoded(df, ranks_path, pattern, id_col, text_col, "ids array<int>, decoded binary", make)


def gathered(df: DataFrame, ranks_path: str, pattern: str, gather: Callable, pack: Callable, text_col: str = "text") -> DataFrame:
    """(gathered binary): each task makes a gather(); its add(pack(ids of a text, as int32 bytes)) and its end() give rows."""
    ranks = _ranks(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, to = _encoder(ranks.value, pattern), gather()
        for batch in batches:
            for text in batch.column(0):
                for row in to.add(pack(encoder.packed(text.as_py() or ""))):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["gathered"])
        yield pa.RecordBatch.from_arrays([pa.array(to.end(), pa.binary())], ["gathered"])

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gathered binary")


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., decoded binary) for every row of df; null ids decode to no bytes; decoded replaces a kept column
    of that name."""
    ranks = _ranks(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _table(ranks.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [b"".join(map(bytes_of.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["kept", "decoded"])

    cols = [id_col, *(c for c in keep if c.lower() != "decoded")]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("kept"), F.col(ids_col).cast("array<int>").alias("ids"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["kept"], T.StructField("decoded", T.BinaryType())]))
    return out.select(*(F.col("kept").getField(c).alias(c) for c in cols), "decoded")
