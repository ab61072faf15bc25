"""Token cost, budgets and progress (B)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_estimate(nodes: DataFrame, snapshots: DataFrame, price_per_million: float) -> DataFrame:
    """B1. Tokens of a full and of an incremental run over each repo's latest snapshot, and the totals (repo null)."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("created_at").desc()))
    ranked = snapshots.select("repo", "commit_sha", rank.alias("r")).filter("r <= 2")
    rows = nodes.select("repo", "commit_sha", "key", "content").join(ranked, ["repo", "commit_sha"])
    new = rows.filter("r = 1").select("repo", "key", F.col("content").alias("now"))
    old = rows.filter("r = 2").select("repo", "key", F.col("content").alias("was"), F.lit(True).alias("known"))
    both = new.join(old, ["repo", "key"], "left").withColumn("fresh", F.col("known").isNull() | ~F.col("now").eqNullSafe(F.col("was")))
    size = F.length(F.coalesce("now", F.lit(""))).cast("long")
    per = both.groupBy("repo").agg(F.ceil(F.sum(size) / 4).alias("full_tokens"), F.ceil(F.sum(F.when(F.col("fresh"), size).otherwise(F.lit(0).cast("long"))) / 4).alias("incremental_tokens"))
    out = per.rollup("repo").agg(F.sum("full_tokens").alias("full_tokens"), F.sum("incremental_tokens").alias("incremental_tokens"))
    full, inc = F.col("full_tokens"), F.col("incremental_tokens")
    return out.withColumns({
        "savings_percent": F.when(full > 0, F.round(100 * (1 - inc / full), 1)).otherwise(F.lit(0.0)),
        "full_cost": F.round(full * F.lit(price_per_million) / 1_000_000, 6), "incremental_cost": F.round(inc * F.lit(price_per_million) / 1_000_000, 6),
    })


def admit_requests(requests: DataFrame, budget: int, day: Column | None = None) -> DataFrame:
    """B2. (repo, day, ord, tokens, admitted): in order of ord, a request is admitted if it still fits the day's budget; a
    refused one uses nothing.

    Whether one fits depends on all before it, so a day of a repo is a fold. It runs over sorted rows, a batch at a time,
    with the sum alone as its state: no group is held in memory.
    """
    rows = requests.select("repo", (day if day is not None else F.to_date("ts")).cast("date").alias("day"), "ord", F.col("tokens").cast("long").alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, 0
        for pdf in batches:
            admitted = []
            for repo, d, tokens in zip(pdf["repo"], pdf["day"], pdf["tokens"]):
                if (repo, d) != at:
                    at, used = (repo, d), 0
                admitted.append(used + tokens <= budget)
                used += tokens if admitted[-1] else 0
            yield pdf.assign(admitted=admitted)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("repo", "day").sortWithinPartitions("repo", "day", "ord").mapInPandas(run, fields + ", admitted boolean")


def progress(repos: DataFrame, now: Column) -> DataFrame:
    """B3. Percent done and seconds since the start, to completion or now."""
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.round(100 * F.col("done") / F.col("total")).cast("int"))).otherwise(0)
    elapsed = F.unix_timestamp(F.coalesce("completed_at", now)) - F.unix_timestamp("started_at")
    return repos.withColumns({"percent": percent, "elapsed_seconds": elapsed})
