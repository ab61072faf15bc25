"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature is a common word (the anchor) and the chain of the CHAIN content words that follow it, common words
skipped. A document's fingerprint is the set of its signatures, kept as sorted distinct 64-bit hashes; its short form is
the SHA-256 of that list. Likeness is the Jaccard similarity of two sets. The length bound prunes: sets of sizes m <= n
can reach a similarity of t only if m >= t * n.

Near duplicates: sets are dealt into partitions by length, so that only the same and the next partition can meet, and
are bucketed there by their rarest signatures: two sets with likeness t share one of the first n - ceil(t * n) + 1 of
each in the global order from rare to common (ties by hash), so every pair meets in a bucket. First the members of a
bucket meet its least id only. Buckets that are then in one component are done; the others are dealt into blocks of
BLOCK sets, and two blocks are compared inside one row, pruned by length, so that only links come out: no bucket yields all
its pairs. Two blocks of a bucket's largest component never meet.

Defined cases: null is the empty text; a text without a signature (no anchor before a content word) has one made of the
whole text, so it equals only itself; repeated rows get equal results; whole texts count. Only the named columns are
read; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.llm.common import connected_components, written

#: Common words of English, French, German and Spanish that anchor a signature (fixed values).
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or she that the this to was were will with "
    "au de des du en est et il la le les par pour que qui sur un une "
    "auf das dem den der die ein eine ist mit nicht sie und von zu "
    "con del el es las los no para por se su una y"
).split()
CHAIN = 2
#: Ranges of ids for each shuffle partition; sets of a block.
RANGES, BLOCK = 2, 64


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and marks."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of the spot signatures of a text. An anchor's place less the number of anchors before it is
    the number of content words before it, so the chain is a slice of the content words."""
    common = lambda w: w.isin(*ANCHORS)

    def of_words(words: Column) -> Column:
        anchors = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: common(x["w"]))
        placed = F.transform(anchors, lambda a, j: F.struct(a["w"].alias("w"), (a["i"] - j).alias("at")))
        content = F.filter(words, lambda w: ~common(w))
        return _let(F.struct(content.alias("c"), F.size(content).alias("n"), placed.alias("a")), chains)

    def chains(s: Column) -> Column:
        whole = F.filter(s["a"], lambda a: a["at"] + CHAIN <= s["n"])
        return F.transform(whole, lambda a: F.xxhash64(a["w"], F.slice(s["c"], a["at"] + 1, F.lit(CHAIN))))

    found = F.array_sort(F.array_distinct(_let(words_of(text), of_words)))
    return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.xxhash64(F.lit("whole"), text))))


def fingerprint(sigs: Column) -> Column:
    return F.sha2(F.array_join(sigs.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, text, next_text): the next row by descending id (ties by text), after the last the first.

    Rows are dealt to ranges of ids cut at approximate quantiles, each range is sorted by itself, and the last row of a
    range meets the first row of the next one: texts move once, and no task sees more than its range. There are RANGES
    times as many ranges as shuffle partitions, which grow with the data. A row finds its range among few of the cuts
    first and then between two of these. Ids may be of any orderable type.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    if isinstance(kind, T.NumericType):
        cuts = rows.select(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("c")).first()["c"] or []
    else:  # evenly spaced ids of a bounded sample
        drawn = sorted(r["id"] for r in rows.filter("id is not null").select("id").orderBy(F.xxhash64("id")).limit(20 * buckets).collect())
        cuts = drawn[:: max(1, len(drawn) // buckets)]
    cuts = sorted(set(cuts))
    step = max(1, math.isqrt(len(cuts)))
    array = lambda xs: F.array(*map(F.lit, xs)).cast(T.ArrayType(kind))
    coarse, fine = array(cuts[::step]), F.array(*(array(cuts[i : i + step]) for i in range(0, len(cuts), step))) if cuts else F.array(array([]))
    # cuts below the id, of the coarse ones and then of those that follow the last of these
    over = F.size(F.filter(coarse, lambda c: c < F.col("id")))
    inner = F.when(over > 0, F.size(F.filter(F.get(fine, over - 1), lambda c: c < F.col("id"))) + (over - 1) * step).otherwise(0)
    # 0 holds the greatest ids; nulls come last of all
    bucket = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - inner)
    rows = rows.withColumn("bucket", bucket)
    by = [F.col("id").desc_nulls_last(), F.col("text")]
    lead = F.lead("text").over(Window.partitionBy("bucket").orderBy(*by))
    inside = rows.repartition("bucket").withColumn("next", lead)

    first = rows.groupBy("bucket").agg(F.max("id").alias("top"))  # at most `buckets` + 1 rows
    order = Window.orderBy("bucket")
    tops = first.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("after"))
    first = rows.join(F.broadcast(first), "bucket").filter(F.col("id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("first_text"))
    first = tops.join(first.withColumnRenamed("bucket", "after"), "after").select("bucket", "first_text")
    out = inside.join(first, "bucket", "left")
    return out.select("id", "text", F.coalesce("next", "first_text").alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def near_duplicates(docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, component_id, kept) for every row of docs: components of links with likeness >= least.

    component_id is the smallest id reachable. A null id is linked with nothing, has a null component and is kept. least is
    in whole hundredths, so that sizes are compared as whole numbers.
    """
    percent = round(100 * least)
    if not 0 < percent < 100 or abs(100 * least - percent) > 1e-9:
        raise ValueError("least is in whole hundredths between 0 and 1")
    least = percent / 100
    rows = docs.select(F.col(id_col).alias("id"), signatures(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sigs"))
    rows = rows.withColumn("sigs", F.when(F.col("id").isNotNull(), F.col("sigs")))
    known = rows.filter("id is not null").groupBy("sigs").agg(F.min("id").alias("rep")).withColumn("n", F.size("sigs"))
    sets = written(known, "spots")
    spots = sets.select("rep", "n", F.explode("sigs").alias("sig"))
    counts = spots.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = spots.join(counts, "sig", "left").withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "sig")))
    prefix = ranked.filter(F.col("df").isNotNull() & (F.col("rank") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1))
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int")  # sizes on a border fall on one side
    buckets = prefix.select("rep", "sig", F.explode(F.array(part, part + 1)).alias("part")).select(F.xxhash64("sig", "part").alias("bucket"), "rep").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("rep").alias(x), F.col("sigs").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        return met.filter(likeness(F.col("sa"), F.col("sb")) >= least).select("a", "b")

    many = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("leader")).filter("size > 1"), "many")
    live = written(buckets.join(many, "bucket"), "buckets")
    edges = written(verify(live.filter("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()), "links")
    parts = connected_components(edges)
    more = written(_cross_links(live.filter("size > 2 and rep != leader"), parts, sets, least), "links")
    if not more.isEmpty():
        parts = connected_components(edges.unionByName(more))
    place = sets.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("sigs", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(place, "sigs", "left")
    return out.select(F.col("id").alias(id_col), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _cross_links(live: DataFrame, parts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the links between different parts that meet in a bucket."""
    placed = live.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component_id", "rep").alias("part"))
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
    mixed = sizes.agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("part", F.struct("c", "part")).alias("main")).filter("size > most")
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = written(mixed.select("bucket", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("size") - F.col("most")).alias("others")), "mixed")
    rows, ours = placed.join(mixed, "bucket"), F.col("part") == F.col("main")
    rows = rows.withColumn("own", F.when(ours, F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("rep"), F.col("others"))).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.when(ours, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    rows = rows.join(sets, "rep").select("bucket", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), F.struct("rep", "part", "n", "sigs", (F.col("own") > F.col("with")).alias("side")).alias("x"))
    groups = rows.groupBy("bucket", "bi", "bj").agg(F.collect_list("x").alias("xs")).filter(F.size("xs") > 1)
    meets = lambda x, y: (
        (x["part"] != y["part"]) & F.when(F.col("bi") == F.col("bj"), x["rep"] < y["rep"]).otherwise(~x["side"] & y["side"])
        & (100 * F.least(x["n"], y["n"]) >= round(100 * least) * F.greatest(x["n"], y["n"])) & (likeness(x["sigs"], y["sigs"]) >= least)
    )
    found = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("xs", lambda y: meets(x, y)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    return groups.select(F.explode(found).alias("l")).select("l.a", "l.b").distinct()
