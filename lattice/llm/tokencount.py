"""Token counts of documents in flat, unindexed token files.

A token file is a plain sequence of big-endian 16-bit ids; a reserved id ends each document; there is no index and no
header. Files are cut into blocks, each block is searched for the reserved id with one vector comparison, and a prefix
scan over the blocks of a file stitches documents that cross block boundaries: what is open when a block begins is the
tail of the last block that had an end, plus all blocks since.

Defined cases: an empty document (two ends in a row) counts 0 tokens, as does one whose ids are null; tokens after the last
end of a file are one more document; an empty file or folder has no documents; a document may span any number of blocks.
An id that is negative, or END or above, is refused, as it could not be told from an end or would not fit. The writer
makes files of about FILE bytes, more only where one document or row is longer; a reader task holds one file at a time.

The end id is 50304: its two bytes C4 80 are one character of UTF-8, so Spark's text sink writes it as the line separator
and the packed ids as the line. A line holds the documents of about ROW bytes, with the end id between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm import bpe

END = 0xC480
#: Bytes of a block, of a line that is written, and of a file.
BLOCK, ROW, FILE = 1 << 20, 1 << 19, 1 << 24
_END = END.to_bytes(2, "big")


def pack(ids: np.ndarray) -> bytes:
    if len(ids) and not (0 <= ids.min() and ids.max() < END):
        raise ValueError(f"token ids must be 0 to {END - 1}")
    return ids.astype(">u2").tobytes()


class Lines:
    """Joins packed documents to lines of `row` bytes or more."""

    def __init__(self, row: int = ROW):
        self.row, self.docs, self.size = row, [], 0

    def add(self, doc: bytes) -> list[bytes]:
        self.docs.append(doc)
        self.size += len(doc) + 2
        return self.end() if self.size >= self.row else []

    def end(self) -> list[bytes]:
        line = [_END.join(self.docs)] if self.docs else []
        self.docs, self.size = [], 0
        return line


def _write(lines: DataFrame, path: str, row: int, file: int) -> None:
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", chr(0x100)).option("maxRecordsPerFile", max(1, file // row)).text(path)


def write_tokens(ids: DataFrame, path: str, ids_col: str = "ids", row: int = ROW, file: int = FILE) -> None:
    """Write array<int> ids (each below END) as token files, one document a row in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(row)
        for batch in batches:
            for x in batch.column(0):
                for line in lines.add(pack(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b""):
                    yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["line"])
        yield pa.RecordBatch.from_arrays([pa.array(lines.end(), pa.binary())], ["line"])

    _write(ids.select(F.col(ids_col).alias("ids")).mapInArrow(run, "line binary"), path, row, file)


def write_texts(docs: DataFrame, path: str, ranks_path: str, pattern: str, text_col: str = "text") -> None:
    """As write_tokens, with the ids of whole texts: encoded and packed in one pass, so that no id list leaves a task."""
    _write(bpe.gathered(docs, ranks_path, pattern, Lines, lambda ids: pack(np.frombuffer(ids, np.int32)), text_col).withColumnRenamed("gathered", "line"), path, ROW, FILE)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, bytes) of token files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content")
    starts = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / block).cast("int"))
    return files.select("file", F.posexplode(F.transform(starts, lambda i: F.substring("content", i * block + 1, F.lit(block)))).alias("block", "bytes"))


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, block, n, ends, head, tail, inner): tokens of a block, ends in it, tokens before the first and after the
    last end, and the counts of the documents that lie between two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n", "ends", "head", "tail", "inner")}
            for b in batch.column(2):
                ids = np.frombuffer(b.as_py(), ">u2")
                at = np.flatnonzero(ids == end)
                out["n"].append(len(ids))
                out["ends"].append(len(at))
                out["head"].append(int(at[0]) if len(at) else len(ids))
                out["tail"].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                out["inner"].append(np.diff(at) - 1 if len(at) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.list_(pa.int64()) if k == "inner" else pa.int64()) for k, v in out.items())], ["file", "block", *out])

    return blocks.mapInArrow(run, "file string, block int, n long, ends long, head long, tail long, inner array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, doc, n_tokens): doc numbers the documents of a file from 0."""
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = scanned.withColumn("after", F.sum("ends").over(so_far)).withColumn("run", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(so_far))
    left = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.sum("tail").over(left)).withColumn("carried", F.coalesce(F.lag("open").over(order), F.lit(0)))
    rows = rows.withColumn("last", F.lead("block").over(order).isNull())
    done = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array("open")).otherwise(F.array().cast("array<long>"))
    docs = rows.select("file", (F.col("after") - F.col("ends")).alias("before"), F.posexplode(F.concat(done, rest)).alias("i", "n_tokens"))
    return docs.select("file", (F.col("before") + F.col("i")).alias("doc"), "n_tokens")


def count_tokens(spark: SparkSession, path: str, block: int = BLOCK, end: int = END) -> DataFrame:
    return stitch(scan(read_blocks(spark, path, block), end))
