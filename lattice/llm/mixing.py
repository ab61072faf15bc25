"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A classifier learned from the label table gives each document a posterior over domains. With n tokens and posterior p, a
document at rate r adds r * n * p to the expected token totals of the domains. Rates r >= 0 are fitted so that the totals
meet the targets: accelerated projected gradient on half the sum of squared gaps, each over its domain's size, from r = 1. In the
metric of token counts the gradient of a document is the dot product of p and the scaled gaps, and the step of 1 is safe
because the scaled Gram matrix is row-stochastic; momentum, started afresh where it overshoots, shortens the way. A round is
one aggregate of K sums over a narrow table; only those K numbers reach the driver.

The classifier is naive Bayes on the presence of hashed tokens (runs of letters, lower-cased; runs of other signs; a mark
for words in capitals). It learns from at most about TRAIN labelled documents of each domain, drawn by a hash of the id,
and keeps every feature whose counts lie TELLING standard deviations or more from chance (of FEATURES at most, so what is
broadcast is below 10 MB whatever the data).

Defined cases: a null text is empty: no tokens, the prior as its posterior, rate 1; labels with a null id, or with null
in what decides the domain, are not learned from; without labels every posterior is uniform; repeated rows get equal rates.
A share of 0 asks for no tokens of that domain. Without a total, the mix keeps the number of tokens there are. An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import written

#: Hashed features, labelled documents of a domain, standard deviations from which a feature tells.
FEATURES, TRAIN, TELLING = 1 << 18, 20_000, 6.0
#: Rounds at most; the gap, and the gain of a round, relative, below which the fit ends.
ROUNDS, TOLERANCE, STALL = 64, 1e-3, 1e-3


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"\p{L}+|[^\p{L}\s]+"), F.lit(0))


def features_of(tokens: Column) -> Column:
    """Distinct hashed features of a document."""
    capital = F.when(F.exists(tokens, lambda t: (F.length(t) > 2) & (t == F.upper(t)) & (t != F.lower(t))), F.array(F.lit(" capitals"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(tokens, capital), lambda t: F.pmod(F.xxhash64(F.lower(t)), F.lit(FEATURES)).cast("int")))


def train(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, w0, w1, ...): for each telling feature the log share of each domain's documents that have it; the last row has
    what every document gets, the log prior. labels: (id_col, domain)."""
    k = range(len(domains))
    rows = labels.filter(F.col(id_col).isNotNull() & F.col("domain").isin(*domains)).select(F.col(id_col).alias("id"), "domain")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    share = F.create_map(*(F.lit(x) for d in domains for x in (d, int(min(1.0, TRAIN / max(1, sizes.get(d, 0))) * 1_000_000))))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < F.element_at(share, F.col("domain")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(drawn), "id").select("domain", features_of(tokens_of(F.col("text"))).alias("f"))  # about TRAIN rows a domain
    found = found.select("domain", F.explode(F.concat(F.col("f"), F.array(F.lit(FEATURES)))).alias("i"))  # FEATURES counts the documents
    seen = found.groupBy("i").agg(*(F.count_if(F.col("domain") == d).alias(f"c{j}") for j, d in enumerate(domains)))
    seen = written(seen, "features")
    n = seen.filter(F.col("i") == FEATURES).first()
    n = [float(n[f"c{j}"]) if n else 0.0 for j in k]
    total = sum(n) + 1.0
    # a domain's share of documents with the feature, drawn to the share in all domains
    all_ = sum((F.col(f"c{j}") for j in k), F.lit(0.5)) / F.lit(total)
    far = F.greatest(*(F.abs(F.col(f"c{j}") - n[j] * all_) / F.sqrt(n[j] * all_ * (1 - all_) + 0.25) for j in k), F.lit(0.0))
    telling = seen.filter(F.col("i") < FEATURES).withColumn("far", far).filter(F.col("far") >= TELLING)
    last = docs.sparkSession.range(1).select(F.lit(FEATURES).alias("i"), *(F.lit(math.log((n[j] + 1) / (total + len(domains) - 1))).alias(f"w{j}") for j in k))
    return telling.select("i", *(F.log((F.col(f"c{j}") + all_) / F.lit(n[j] + 1)).alias(f"w{j}") for j in k)).unionByName(last)


def posteriors(docs: DataFrame, weights: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, p array<double>) for every row. The weights are FEATURES + 1 narrow rows at most, so they are broadcast; the
    features of a row are added up where they arise, and one row a document is shuffled."""
    k = range(len(domains))
    tokens = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), tokens_of(F.col(text_col)).alias("t"))
    found = tokens.select("_row", "_id", F.size("t").cast("long").alias("n_tokens"), F.explode(F.concat(features_of(F.col("t")), F.array(F.lit(FEATURES)))).alias("i"))
    sums = found.join(F.broadcast(weights), "i").groupBy("_row", "_id", "n_tokens").agg(*(F.sum(f"w{j}").alias(f"s{j}") for j in k))
    top = F.greatest(*(F.col(f"s{j}") for j in k)) if len(domains) > 1 else F.col("s0")
    e = [F.exp(F.col(f"s{j}") - top) for j in k]
    return sums.select(F.col("_id").alias(id_col), "n_tokens", F.array(*(x / sum(e[1:], e[0]) for x in e)).alias("p"))


def fit_rates(parts: DataFrame, shares: list[float], total: float | None = None) -> DataFrame:
    """parts (n_tokens, p, ...) with a rate >= 0 for each row; expected domain totals meet shares * total as nearly as
    nonnegative rates can."""
    k, weight = len(shares), sum(shares)
    if weight <= 0 or min(shares) < 0:
        raise ValueError("shares must be nonnegative, with a positive sum")
    p = [F.get("p", F.lit(i)) for i in range(k)]
    sums = lambda df: [float(x or 0) for x in df.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * p[i]) for i in range(k))).first()]
    at = written(parts.withColumns({"rate": F.lit(1.0), "_before": F.lit(1.0)}), "rates")
    now = before = first = sums(at)
    if not sum(first):
        return at.drop("_before")
    if total is None:
        total = sum(first)
    goal = [s / weight * total for s in shares]
    best, age = float("inf"), 1.0
    for step in range(ROUNDS):
        gap = sum((a - b) ** 2 / f for a, b, f in zip(now, goal, first) if f > 0) / total
        if gap <= TOLERANCE**2 or 0 <= best - gap <= STALL * gap:
            break
        older = age
        age = 1.0 if gap > best else (1 + math.sqrt(1 + 4 * age * age)) / 2  # momentum starts afresh where it overshoots
        push = 0.0 if age == 1.0 else (older - 1) / age
        best = gap
        # totals are linear in the rates, so those of the point ahead need no look at the rows
        ahead = [a + push * (a - b) for a, b in zip(now, before)]
        pull = sum((p[i] * F.lit((ahead[i] - goal[i]) / first[i]) for i in range(k) if first[i] > 0), F.lit(0.0))
        point = F.col("rate") + F.lit(push) * (F.col("rate") - F.col("_before"))
        at = at.withColumns({"rate": F.greatest(F.lit(0.0), point - pull), "_before": F.col("rate")})
        if step % 4 == 3:
            at = written(at, "rates")
        now, before = sums(at), now
    return at.drop("_before")


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a label row: toxic, else high or low by quality; null if neither can be told."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, p, rate) for every row of docs. labels: (id_col, domain); shares: target weight of each domain."""
    domains = list(shares)
    weights = written(train(docs, labels, domains, id_col, text_col), "weights")
    parts = posteriors(docs, weights, domains, id_col, text_col)
    return fit_rates(parts, list(shares.values()))


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of copies with the rate as its mean: rounded by a hash of the key."""
    return F.floor(rate + F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / F.lit(1 << 20)).cast("int")
