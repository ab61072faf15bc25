"""URL filter with redirect equivalence, in DataFrame functions only.

A rule names a host and a path: it fits the host and its subdomains where the url's path starts with the rule's, and the
longest rule that fits decides. Urls that redirect to each other, or name each other as canonical, are aliases: connected
components over these edges. A url without a rule of its own is blocked if a rule blocks any of its aliases; a url with a
rule keeps its own verdict, so an explicit allow stands inside a blocked component; of an allow and a block of the same
host and path the allow counts. Everything else is allowed.

Edges come from <link rel="canonical">, from <meta http-equiv="refresh"> (both outside of comments and scripts), and from a
table of redirects if one is given. Aliases are compared without scheme and fragment and with a lower-cased host; relative
links are resolved against the page's url, without <base> and with `..` left as it is.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; it is allowed. A null page has no
edges. Repeated rows get equal verdicts. Empty tables give empty results. Only the named columns are read. The rules may
be many: they meet the urls in a join on host suffixes, not in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.llm.common import connected_components, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Host, path and query; null for a url without `://`."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def targets(url: Column, html: Column) -> Column:
    """Absolute urls that a page redirects to or names as canonical (array<string>)."""
    telling = html.rlike(r"(?i)\bcanonical\b|http-equiv")
    html = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|template)\b.*?(?:</\1\s*>|\z)", "")
    canonical = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")),
        lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    refresh = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")),
        lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    origin = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.concat(origin, F.regexp_extract(F.concat(path_of(url)), r"^(.*/)?", 0))
    whole = lambda t: (
        F.when(F.instr(t, "://") > 0, t)
        .when(t.startswith("//"), F.concat(F.regexp_extract(url, r"^[^:/?#]*:", 0), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(origin, F.lit("/"))), t))
    )
    found = F.transform(F.filter(F.concat(canonical, refresh), lambda t: t != ""), lambda t: whole(F.replace(t, F.lit("&amp;"), F.lit("&"))))
    return F.when(telling, found)


def decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for each distinct (host, path) that a rule of (action, host, path) fits."""
    suffix = F.expr(r"transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    spread = places.filter("host <> ''").select("host", "path").distinct().withColumn("suffix", F.explode(suffix))
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "action", F.concat("host", "path").alias("rule"))
    fits = spread.join(own, "suffix").filter(F.col("path").startswith(F.col("start")))
    best = F.max(F.struct(F.length("rule").alias("length"), "rule", (F.col("action") == "allow").alias("allows"), "action")).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages. redirects: (from_url, to_url)."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    seen = rows.select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key"))

    linked = rows.select("url", F.explode(targets(url, F.col("html"))).alias("target"))
    if redirects is not None:
        linked = linked.unionByName(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("target")))
    linked = written(linked, "aliases")  # pages are searched once
    edges = linked.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"))
    parts = connected_components(edges)  # (id, component_id) of the keys that have an alias
    ends = linked.select(F.explode(F.array("url", "target")).alias("url")).select(host_of(url).alias("host"), path_of(url).alias("path"), alias_key(url).alias("key")).distinct()

    ruled = decide(seen.select("host", "path").unionByName(ends.select("host", "path")), rules)
    blocked = ends.join(ruled.filter("action = 'block'"), ["host", "path"]).join(parts, F.col("key") == parts["id"]).select("component_id").distinct()
    aliases = parts.join(blocked, "component_id").select(F.col("id").alias("key"), F.lit(True).alias("alias_blocked"))
    out = seen.join(ruled, ["host", "path"], "left").join(aliases, "key", "left")
    verdict = F.coalesce("action", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
