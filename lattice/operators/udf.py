"""Pluggable functions (U): summariser, embedder, edge proposer, with rule-based defaults."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions.tables import cut
from lattice.operators.textgen import rule_summaries

SNAP = ["repo", "commit_sha"]
SUMMARY = "repo string, commit_sha string, key string, content string, confidence double, model string, prompt_version string"


def summarize_with(entities: DataFrame, rels: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """U1. fn makes summaries (SUMMARY's columns) of a batch of entities; an entity that it leaves out, and a batch that it
    fails on, gets the rule-based summary. What fn makes is written, so it sees each entity once; batches that fail are
    counted in a warning, which names one of the errors."""
    ruled = rule_summaries(entities, rels)
    if fn is None:
        return ruled

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                out = fn(pdf)
            except Exception as e:  # a failed batch falls back to the rules
                out = pd.DataFrame([(None, None, None, None, None, f"{type(e).__name__}: {e}", None)], columns=[f.split()[0] for f in SUMMARY.split(", ")])
            yield out

    told = cut(entities.mapInPandas(run, SUMMARY))
    failed = told.filter("key is null and content is null").agg(F.count(F.lit(1)), F.min("model")).first()
    if failed[0]:
        warnings.warn(f"{failed[0]} batches got rule-based summaries; {failed[1]}", stacklevel=2)
    made = told.filter("content is not null")
    return made.unionByName(ruled.join(made.select(*SNAP, "key"), [*SNAP, "key"], "left_anti"))


def hashed_words(dim: int = 64) -> Callable[[Column], Column]:
    """U2. The default embedder, in built-in functions: signed hashed words, unit length; a text without words, or whose
    words cancel out, has no vector."""

    def once(value: Column, f: Callable[[Column], Column]) -> Column:
        """f of a value that is made once for a row, however often f has it, also inside lambdas."""
        return F.get(F.transform(F.array(F.struct(value.alias("v"))), lambda s: f(s["v"])), F.lit(0))

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+"), lambda w: w != "")
        hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"))
        many = lambda hs, h: F.size(F.filter(hs, lambda x: x == h)).cast("long")
        at = lambda d, hs: F.map_from_arrays(d, F.transform(d, lambda i: many(hs, 2 * i + 1) - many(hs, 2 * i)))  # noqa: E731  # words of sign 1 less those of sign -1
        sums = once(F.transform(hashes, lambda h: h % (2 * dim)), lambda hs: at(F.array_distinct(F.transform(hs, lambda h: F.floor(h / 2))), hs))
        v = once(sums, lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("long"))))
        return once(v, unit)

    def unit(v: Column) -> Column:
        return once(F.sqrt(F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: acc + x * x)), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)))

    return embed


def propose_with(candidates: DataFrame, fn: Callable[[pd.DataFrame], str]) -> DataFrame:
    """U3. (SNAP, json): fn makes a JSON list of edges from a snapshot's candidates (at most 120 rows, by L14)."""
    cols = [*SNAP, "key", "path", "symbol", "kind", "language"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"repo": [pdf["repo"].iloc[0]], "commit_sha": [pdf["commit_sha"].iloc[0]], "json": [fn(pdf)]})

    return candidates.select(*cols).groupBy(*SNAP).applyInPandas(run, "repo string, commit_sha string, json string")
