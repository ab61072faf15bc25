"""Checks and de-duplication of parsed entities and relationships (V). `ord` is the input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SNAP = ["repo", "commit_sha"]


def _blank(c: str):
    return ~F.coalesce(F.col(c), F.lit("")).rlike(r"[^\s\p{Z}]")


def _errors(df: DataFrame, key: str, *checks) -> DataFrame:
    found = F.filter(F.array(*(F.when(cond, F.lit(text)) for cond, text in checks)), lambda x: x.isNotNull())
    return df.select(*SNAP, F.col(key), "ord", F.explode(found).alias("error"))


def validate_entities(entities: DataFrame) -> DataFrame:
    """V1. One row per error; a blank key hides the other errors of its row."""
    first = F.row_number().over(Window.partitionBy(*SNAP, "key").orderBy("ord"))
    rows = entities.withColumn("_n", first)
    blank = _blank("key")
    return _errors(rows, "key", (blank, "blank key"), (~blank & (F.col("_n") > 1), "duplicate key"), (~blank & ((F.col("start_line") < 0) | (F.col("end_line") < F.col("start_line"))), "invalid lines"))


def validate_relationships(rels: DataFrame) -> DataFrame:
    """V2. Blank ends and confidences outside [0, 1]."""
    return _errors(rels.withColumn("key", F.concat_ws(" > ", "from_key", "to_key")), "key", (_blank("from_key") | _blank("to_key"), "blank endpoint"), (~F.col("confidence").between(0, 1), "confidence out of range"))


def dangling_edges(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """V3. Relationships with an end that is no entity, as warnings."""
    keys = entities.select(*SNAP, "key").distinct()
    end = lambda c: keys.select(*SNAP, F.col("key").alias(c), F.lit(True).alias(f"has_{c}"))
    out = rels.join(end("from_key"), [*SNAP, "from_key"], "left").join(end("to_key"), [*SNAP, "to_key"], "left")
    out = out.filter("has_from_key is null or has_to_key is null")
    return out.select(*SNAP, "from_key", "to_key", "type", F.col("has_from_key").isNull().alias("from_missing"), F.col("has_to_key").isNull().alias("to_missing"))


def _first(df: DataFrame, *ids: str) -> DataFrame:
    w = Window.partitionBy(*SNAP, *ids).orderBy("ord")
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """V4. First row of each key."""
    return _first(entities, "key")


def dedupe_edges(rels: DataFrame) -> DataFrame:
    """V5. First row of each (from, to, type); its confidence and evidence win too."""
    return _first(rels, "from_key", "to_key", "type")
