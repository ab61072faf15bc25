"""From documents to token ids: language ID, near-duplicate removal, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import bpe, language, mixing, setsketch
from lattice.llm.common import shared_dir
from lattice.llm.queries import RANKS, SHARES, domain_labels


def _rows(docs: DataFrame) -> DataFrame:
    """Each row of docs as one struct, so that no column of it can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letter, or unlike every learned language (language.LEAST_SCORE) though
    long enough to tell (language.LEAST_LETTERS). All other rows stay, repeated rows and rows without an id included."""
    prototypes = language.train(docs.filter(~language.held_out()))
    return language.known(docs, prototypes)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates. Rows that repeat an id are one document, whose different texts
    all stay, or go with the group that each is in; rows that repeat id and text stay once. Rows without an id stay."""
    found = setsketch.near_duplicates(docs, text_hash=True).filter("kept and doc_id is not null")
    kept = found.select("doc_id", "text_hash").distinct()
    rows = _rows(docs).withColumn("_id", F.col("doc.doc_id")).withColumn("_hash", setsketch.text_hash(F.col("doc.text")))
    one = rows.join(kept, (F.col("_id") == kept["doc_id"]) & (F.col("_hash") == kept["text_hash"]), "left_semi").dropDuplicates(["_id", "_hash"])
    return _columns(one.unionByName(rows.filter("_id is null")), docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as its fitted rate asks (rounded by a hash of the id, with the rate as the mean); documents
    of a domain without a share go. Rows that repeat an id take the greatest rate among them; rows without an id stay
    once."""
    rates = mixing.mix(docs, domain_labels(spark, sf_dir), SHARES)
    times = rates.filter("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("rate"))
    times = times.select(F.col("doc_id").alias("_id"), mixing.copies(F.col("rate"), F.col("doc_id")).alias("_times")).filter("_times > 0")
    rows = _rows(docs).withColumn("_id", F.col("doc.doc_id"))
    many = rows.join(times, "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return _columns(many.select("doc").unionByName(rows.filter("_id is null").select("doc")), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    out = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_to_targets),
    ("byte_bpe", encode_and_decode),
]

#: No SQL can express the language model, the fitted rates or the byte pairs; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/lattice/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
