"""Structured Streaming forms (ST)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lattice.operators.snapshots import edge_history

REPO_STATE = "repo string, name string, clone_url string, branch string, status string, installation_id long"


def _at(row: dict, *names):
    return next((row[n] for n in names if row.get(n) not in (None, "")), None)


class _RepoState(StatefulProcessor):
    """State of one repository: name, clone url, branch, status, installation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("repo", "name string, clone_url string, branch string, status string, installation_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else None
        events = pd.concat(list(rows)).sort_values("ord", kind="stable")
        before = None if now is None else list(now)
        for e in events.to_dict("records"):
            event, action = e["event"], e.get("action")
            if event == "push" and now is not None and now[3] != "disconnected":
                now = [_at(e, "name") or now[0], _at(e, "clone_url") or now[1], _at(e, "branch") or now[2], "pending", now[4]]
            elif event == "known" and now is None or event == "installation" and action in ("created", "added"):
                old = now or [None] * 5
                url = _at(e, "clone_url") or old[1] or f"https://github.com/{key[0]}.git"
                status = _at(e, "status") or "pending" if event == "known" else "pending"
                ident = e.get("installation_id")
                now = [_at(e, "name") or old[0] or key[0].split("/")[-1], url, _at(e, "branch") or old[2], status, old[4] if pd.isna(ident) else int(ident)]
            elif event == "installation" and action == "removed" and now is not None:
                now = [*now[:3], "disconnected", now[4]]
        if now is not None and now != before:
            self.state.update(tuple(now))
            yield pd.DataFrame([[key[0], *now]], columns=["repo", "name", "clone_url", "branch", "status", "installation_id"])

    def close(self) -> None:
        pass


def stream_repo_state(events: DataFrame) -> DataFrame:
    """ST1. events: repo, ord, event (push, installation, known, ...), action, name, clone_url, branch, status,
    installation_id. Emits a repo's row whenever it changes; unknown and disconnected repos ignore pushes; many pushes
    leave one pending run. Repos that are known beforehand enter as `known` events from their table."""
    return events.groupBy("repo").transformWithStateInPandas(_RepoState(), REPO_STATE, "Update", "None")


PR_QUEUE = "repo string, number long, head string, base string, status string, attempt int"


class _PrState(StatefulProcessor):
    """Review of one (repo, number, head): base, status, attempt, time of the last event. keep: milliseconds after which a
    review without events is forgotten, or None."""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("review", "base string, status string, attempt int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.state.get()) if self.state.exists() else None
        out, before = [], now and now[3]
        for e in pd.concat(list(rows)).sort_values("ord", kind="stable").to_dict("records"):
            at = max(now[3] if now else 0, int(e["ts"].timestamp() * 1000)) if self.keep is not None else 0
            if e["event"] == "pull_request" and e["action"] in ("opened", "reopened", "synchronize"):
                if now is None or now[1] == "failed":
                    now = [e["base"], "pending", (now[2] if now else 0) + 1, at]
                    out.append([*key, *now[:3]])
            elif e["event"] == "review_result" and now is not None:
                now = [now[0], e["action"], now[2], at]
            if now is not None:
                now[3] = at
        if now is not None:
            self.state.update(tuple(now))
            if self.keep is not None and now[3] != before:
                if before is not None:
                    self.handle.deleteTimer(before + self.keep)
                self.handle.registerTimer(now[3] + self.keep)
        if out:
            yield pd.DataFrame(out, columns=["repo", "number", "head", "base", "status", "attempt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_pr_queue(events: DataFrame, delay: str = "1 hour", keep_days: int = 30) -> DataFrame:
    """ST2. events: repo, number, head, base, ord, event (pull_request or review_result), action, and ts if state is to
    end. One queued review for each (repo, number, head); a failed one is queued again when the pull request comes again,
    with the new base. With ts, events later than delay are ignored, and a review is forgotten once the watermark is
    keep_days past its last event; a pull request that comes after that is queued as new."""
    timed = "ts" in events.columns
    rows = events.withWatermark("ts", delay) if timed else events
    mode = ("Append", "EventTime") if timed else ("Update", "None")
    return rows.groupBy("repo", "number", "head").transformWithStateInPandas(_PrState(keep_days * 86_400_000 if timed else None), PR_QUEUE, *mode)


def stream_edge_history(snapshots: DataFrame, path: str, checkpoint: str):
    """ST3. snapshots: a stream of edges (repo, commit_sha, from_key, to_key, type, created_at). Returns the writer; start it.

    A trigger writes the sightings (edge, commit) that it brought to a folder of its own number, so a trigger that is done
    again replaces what it wrote, its work is in proportion to its rows, and a commit may come in any number of triggers
    and any order. What follows from an edge's absence is worked out when the history is read: see read_edge_history."""

    def step(batch: DataFrame, number: int) -> None:
        batch.select(*SIGHTING).distinct().write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


SIGHTING = ("repo", "commit_sha", "from_key", "to_key", "type", "created_at")


def read_edge_history(spark: SparkSession, path: str) -> DataFrame:
    """ST3. The history, as M11, of all commits that have come so far."""
    seen = spark.read.schema(", ".join(f"{c} {'timestamp' if c == 'created_at' else 'string'}" for c in SIGHTING)).parquet(path).select(*SIGHTING)
    commits = seen.groupBy("repo", "commit_sha").agg(F.min("created_at").alias("created_at"))
    return edge_history(seen.drop("created_at"), commits)


ADMITTED = "repo string, day date, ord long, tokens long, admitted boolean"


class _Budget(StatefulProcessor):
    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("used", "used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = not self.state.exists()
        used = 0 if first else self.state.get()[0]
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        admitted = []
        for tokens in pdf["tokens"]:
            admitted.append(bool(used + tokens <= self.budget))
            used += int(tokens) if admitted[-1] else 0
        self.state.update((used,))
        if first:  # the day is over once the watermark has passed its end
            self.handle.registerTimer(int(pd.Timestamp(key[1]).timestamp() * 1000) + 86_400_000)
        yield pd.DataFrame({"repo": key[0], "day": key[1], "ord": pdf["ord"], "tokens": pdf["tokens"], "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_admit(requests: DataFrame, budget: int, delay: str = "1 hour") -> DataFrame:
    """ST4. requests: repo, ts, ord, tokens. As B2, with the sum of each (repo, UTC day) as state, dropped once the
    watermark passes the day; requests of a day that is gone are late and are ignored."""
    rows = requests.withWatermark("ts", delay).select("repo", F.to_date("ts").alias("day"), F.col("ord").cast("long").alias("ord"), F.col("tokens").cast("long").alias("tokens"), "ts")
    return rows.groupBy("repo", "day").transformWithStateInPandas(_Budget(budget), ADMITTED, "Append", "EventTime")
