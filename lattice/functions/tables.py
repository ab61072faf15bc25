"""Writing an intermediate result of a loop to the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def place(spark: SparkSession, name: str = "loop") -> str:
    """A new folder in the shared one, which all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="lattice-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/lattice/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the folder of spark.checkpoint.dir (a temporary one only where that is unset, on a local master) and read
    back: the lineage of a loop ends here, and lost executors do not matter."""
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_count(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """As cut, with the number of rows (of which the condition holds), counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, (F.count(F.lit(1)) if which is None else F.count_if(which)).alias("n")))
    return out, seen.get["n"]


#: Rows of a partition of what a loop holds.
HELD = 250_000


@contextlib.contextmanager
def held(df: DataFrame, key: str, rows: int) -> Iterator[DataFrame]:
    """df, which has been written, dealt by key and sorted once, and kept by the executors (in memory, or on their disks) for
    the joins of a loop by that key, which then need not shuffle it again. A lost part is dealt again from what was written."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(max(own, -(-rows // HELD)), key).sortWithinPartitions(key).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


class Pile:
    """A table that grows by a written part each round of a loop. As soon as FAN parts of a size class are there they
    become one part of the next class, so a reader scans FAN parts a class at most and a row is rewritten once a class."""

    FAN = 8

    def __init__(self, *parts: DataFrame):
        self._classes: list[list[DataFrame]] = [list(parts)]

    def add(self, part: DataFrame) -> None:
        """part has been written."""
        at = 0
        while True:
            if at == len(self._classes):
                self._classes.append([])
            self._classes[at].append(part)
            if len(self._classes[at]) < self.FAN:
                return
            part = cut(_union(self._classes[at]))
            self._classes[at] = []
            at += 1

    def all(self) -> DataFrame:
        return _union([part for parts in self._classes for part in parts])

    @property
    def scans(self) -> int:
        return sum(map(len, self._classes))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
