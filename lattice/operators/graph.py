"""Graph queries (G). Tables hold many snapshots; SNAP names a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions import scalars as C
from lattice.functions.tables import Pile, cut, cut_and_count, held
from lattice.operators import snapshots as S

SNAP = ["repo", "commit_sha"]
STORAGE_TYPES, API_TYPES = ("Injected", "FieldDependency"), ("InvokesEndpoint", "Publishes", "Consumes")


def search(edges: DataFrame, starts: DataFrame, max_depth: int, carry: tuple[str, ...] = (), reverse: bool = False, undirected: bool = False, trace: bool = True, parent: bool = False) -> DataFrame:
    """Multi-source breadth-first search, level by level.

    starts: SNAP + source (a key). Returns SNAP + source, key, depth, trace (array of keys, least among the shortest; left out
    without `trace`), with `parent` the key before it on that trace, and the carried columns of the edge that reached the key.
    The source itself is depth 0.

    Keys are numbered in their order, and levels hold numbers only (see reached). Each level joins the frontier with the edges, drops what
    was seen (anti join), keeps the least candidate per (source, key) and is written, so a level's plan does not grow; all
    sources go in one pass. Where traces or carried columns are asked for, a level's rows are numbered in the order of their
    traces, so the least number names the parent; traces are put together at the end, level by level, once a row."""
    at, to = ("to_key", "from_key") if reverse else ("from_key", "to_key")
    kinds, ordered = {f.name: f.dataType for f in edges.schema}, trace or parent or bool(carry)
    pairs = edges.select(*SNAP, F.col(at).alias("at"), F.col(to).alias("next"))
    starts = starts.select(*SNAP, "source").distinct()
    names = pairs.select(*SNAP, F.explode(F.array("at", "next")).alias("key")).unionByName(starts.select(*SNAP, F.col("source").alias("key"))).distinct()
    names = cut(names)
    names = cut((names.orderBy("key") if ordered else names).withColumn("id", F.monotonically_increasing_id()))
    number = lambda c: names.select(*SNAP, F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    numbered = lambda df, *more: df.join(number("at"), [*SNAP, "at"]).select(*SNAP, "next", F.col("at_id").alias("at"), *more).join(number("next"), [*SNAP, "next"]).select("at", F.col("next_id").alias("next"), *more)
    ends = numbered(pairs.distinct())
    ends = cut(ends.unionByName(ends.select(F.col("next").alias("at"), F.col("at").alias("next"))).distinct() if undirected else ends)
    told = reached(ends, starts.join(number("source"), [*SNAP, "source"]).select(F.col("source_id").alias("source")), max_depth, names if trace else None, ordered)
    told = told.join(names.select("id", *SNAP, "key"), "id")
    if carry:
        edge = edges.select(*SNAP, F.col(at).alias("at"), F.col(to).alias("next"), *carry)
        if undirected:
            edge = edge.unionByName(edge.select(*SNAP, F.col("next").alias("at"), F.col("at").alias("next"), *carry))
        edge = numbered(edge, *carry).groupBy(F.col("at").alias("parent"), F.col("next").alias("id")).agg(F.min(F.struct(*carry)).alias("_c"))
        told = told.join(edge, ["parent", "id"], "left").withColumns({c: F.col(f"_c.{c}").cast(kinds[c]) for c in carry})
    told = told.join(names.select(F.col("id").alias("source"), F.col("key").alias("_source")), "source")
    if parent:
        told = told.join(names.select(F.col("id").alias("parent"), F.col("key").alias("_parent")), "parent", "left")
    more = [*(["trace"] if trace else []), *([F.col("_parent").alias("parent")] if parent else [])]
    return told.select(*SNAP, F.col("_source").alias("source"), "key", "depth", *more, *carry)


def reached(ends: DataFrame, starts: DataFrame, max_depth: int, names: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """The search on numbers. ends: (at, next), distinct, written; starts: source. Returns (source, id, depth), with `ordered`
    the parent on the least trace, and with names (id, key) the trace of keys; numbers are in the order of the keys then. The
    edges are dealt once and held, so a level shuffles its own rows and what was seen, and no edge."""
    front = cut(starts.distinct().select("source", F.col("source").alias("id"), F.lit(0).cast("long").alias("rank"), F.lit(None).cast("long").alias("parent")))
    seen, levels, ordered = Pile(front.select("source", "id")), [front], ordered or names is not None
    with held(ends, "at", ends.count()) as dealt:
        for _ in range(max_depth):
            step = front.select("source", F.col("id").alias("at"), "rank").join(dealt, "at")
            if ordered:
                best = step.groupBy("source", F.col("next").alias("id")).agg(F.min(F.struct("rank", F.col("at").alias("parent"))).alias("b")).select("source", "id", F.col("b.rank").alias("up"), "b.parent")
            else:
                best = step.select("source", F.col("next").alias("id")).distinct()
            best, n = cut_and_count(best.join(seen.all(), ["source", "id"], "left_anti"))
            if not n:
                break
            front = cut(best.orderBy("up", "id").select("source", "id", F.monotonically_increasing_id().alias("rank"), "parent")) if ordered else best.withColumn("rank", F.lit(0).cast("long"))
            seen.add(front.select("source", "id"))
            levels.append(front)
    told = None
    for depth, level in enumerate(levels):
        rows = level.select("source", "id", *(["parent"] if ordered else []), F.lit(depth).alias("depth"))
        if names is not None:
            rows = rows.join(names.select("id", "key"), "id")
            if depth:
                rows = rows.join(above.select("source", F.col("id").alias("parent"), "trace"), ["source", "parent"]).withColumn("trace", F.concat("trace", F.array("key")))  # noqa: F821
            else:
                rows = rows.withColumn("trace", F.array("key"))
            above = rows = cut(rows.drop("key"))
        told = rows if told is None else told.unionByName(rows)
    return told


def bit_search(edges: DataFrame, groups: DataFrame, max_depth: int, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from many groups of sources at once, 64 to a word.

    groups: SNAP, key, word, bit; a group is a bit of a word, its sources are the keys of one snapshot that carry it.
    Returns (levels, names). levels: id, word, depth, bits, came: the groups that reach a node first at that depth, and those
    that came before (a group's own sources, at depth 0, do not count). names: SNAP, key, id. A frontier row stands for up
    to 64 groups; the words that meet at a node become one by bit_or, before the shuffle and after it. The edges are
    written once, as pairs of numbers."""
    pairs = edges.select(*SNAP, F.col("to_key" if reverse else "from_key").alias("at"), F.col("from_key" if reverse else "to_key").alias("next")).distinct()
    names = pairs.select(*SNAP, F.explode(F.array("at", "next")).alias("key")).unionByName(groups.select(*SNAP, "key")).distinct()
    names = cut(names.withColumn("id", F.monotonically_increasing_id()))
    number = lambda c: names.select(*SNAP, F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    ends = cut(pairs.join(number("at"), [*SNAP, "at"]).join(number("next"), [*SNAP, "next"]).select(F.col("at_id").alias("id"), F.col("next_id").alias("next")))
    front = cut(groups.join(names, [*SNAP, "key"]).groupBy("word", "id").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")))
    seen, levels = Pile(front.withColumn("came", F.lit(0).cast("long"))), []
    for depth in range(1, max_depth + 1):
        step = front.select("word", "id", "bits").join(ends, "id").groupBy("word", F.col("next").alias("id")).agg(F.bit_or("bits").alias("new"))
        known = seen.all().groupBy("word", "id").agg(F.bit_or("bits").alias("old"), F.bit_or("came").alias("came"))
        step = step.join(known, ["word", "id"], "left").na.fill(0, ["old", "came"]).withColumn("bits", F.col("new").bitwiseAND(F.bitwise_not("old"))).filter("bits != 0")
        front, n = cut_and_count(step.select("id", "word", F.lit(depth).alias("depth"), "bits", "came"))
        if not n:
            break
        seen.add(front.select("word", "id", "bits", F.col("bits").alias("came")))
        levels.append(front)
    if not levels:
        levels.append(front.limit(0).select("id", "word", F.lit(0).alias("depth"), "bits", F.lit(0).cast("long").alias("came")))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, names


def in_words(items: DataFrame, a_word: int) -> DataFrame:
    """items, written, with slot, word and nth: so many neighbouring rows share a word."""
    own = cut(items.withColumn("slot", F.monotonically_increasing_id()))
    return own.withColumns({"word": F.expr(f"slot div {a_word}"), "nth": (F.col("slot") % a_word).cast("int")})


def counts_of(levels: DataFrame, by: list[str], masks: list[int]) -> DataFrame:
    """(word, nth, by..., n): rows of each word at which the groups of the n-th mask come first, counted before the shuffle."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    first = lambda m: (F.col("bits").bitwiseAND(F.lit(m).cast("long")) != 0) & (F.col("came").bitwiseAND(F.lit(m).cast("long")) == 0)
    sums = levels.groupBy("word", *by).agg(*(F.count_if(first(m)).alias(f"n{i}") for i, m in enumerate(signed)))
    return sums.select("word", *by, F.posexplode(F.array(*(f"n{i}" for i in range(len(masks))))).alias("nth", "n")).filter("n > 0")


def _place(items: DataFrame, nodes: DataFrame, key: str = "key") -> DataFrame:
    """Symbol, path and line of a key; an unknown key is its own symbol, at path '' and line 0."""
    own = nodes.select(*SNAP, F.col("key").alias(key), F.col("symbol").alias("_s"), F.col("path").alias("_p"), F.col("start_line").alias("_l"))
    out = items.join(own, [*SNAP, key], "left")
    return out.withColumns({"symbol": F.coalesce("_s", F.col(key).cast("string")), "path": F.coalesce("_p", F.lit("")), "line": F.coalesce("_l", F.lit(0))}).drop("_s", "_p", "_l")


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 10, trace: bool = True) -> DataFrame:
    """G1. Everything that reaches a source over edges of any type, with severity and (if asked for) trace."""
    found = search(edges, starts, max_depth, reverse=True, trace=trace).filter("depth > 0")
    return _place(found, nodes).withColumn("severity", F.when(F.col("depth") == 1, "direct").otherwise("indirect"))


def chain(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 10, trace: bool = True) -> DataFrame:
    """G2. Everything that a source reaches, with the edge that reached it and (if asked for) the trace."""
    found = search(edges, starts, max_depth, carry=("type", "evidence", "confidence", "is_static"), trace=trace).filter("depth > 0")
    return _place(found, nodes).withColumns(C.classify_edge(F.col("is_static"), F.col("confidence")))


def consumers(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """G3. One row for each edge into a source."""
    found = edges.join(starts.select(*SNAP, F.col("source").alias("to_key")), [*SNAP, "to_key"]).withColumnRenamed("from_key", "key")
    return _place(found, nodes).withColumns(C.classify_edge(F.col("is_static"), F.col("confidence")))


def neighborhood(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """G4. SNAP + source, key, depth within so many steps in any direction, the source included."""
    return search(edges, starts, depth, undirected=True, trace=False).select(*SNAP, "source", "key", "depth")


def within(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with both ends among keys (SNAP + key)."""
    out = edges
    for end in ("from_key", "to_key"):
        out = out.join(keys.select(*SNAP, F.col("key").alias(end)).distinct(), [*SNAP, end], "left_semi")
    return out


def module_subgraph(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """G5. Nodes under a path prefix (any case), and the edges among them."""
    own = nodes.filter(F.lower("path").startswith(prefix.lower()))
    return own, within(edges, own)


def _wanted(source: str | None, tier: str | None, evidence: str) -> Column:
    keep = F.lit(True)
    if source in ("facts", "inferences"):
        keep = keep & (F.col(evidence) == source[:-1])
    return keep & (F.col("tier") == tier) if tier else keep


def graph(nodes: DataFrame, edges: DataFrame, entity: str | None = None, module: str | None = None, depth: int = 3, source: str | None = None, tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """G6. Restriction by neighbourhood or module, then source and tier filters on nodes and on edges separately."""
    if entity is not None:
        near = neighborhood(edges, nodes.select(*SNAP).distinct().withColumn("source", F.lit(entity)), depth)
        nodes, edges = nodes.join(near.select(*SNAP, "key"), [*SNAP, "key"], "left_semi"), within(edges, near)
    elif module is not None:
        nodes, edges = module_subgraph(nodes, edges, module)
    n = nodes.withColumns(C.classify_node(F.col("model"), F.col("confidence"), F.col("review_status"))).filter(_wanted(source, tier, "evidence"))
    e = edges.withColumns(C.classify_edge(F.col("is_static"), F.col("confidence"))).filter(_wanted(source, tier, "evidence_class"))
    return n, e


def simple_cycles(edges: DataFrame, max_len: int = 5) -> DataFrame:
    """G7. SNAP + cycle, length: simple cycles of up to max_len edges, from the least key, which ends the array again. The
    search runs on numbers; keys come back at the end, for the cycles that were found. Longer cycles show as components:
    see cycle_groups."""
    pairs = edges.select(*SNAP, "from_key", "to_key").distinct()
    nodes = cut(pairs.select(*SNAP, F.explode(F.array("from_key", "to_key")).alias("key")).distinct().withColumn("id", F.monotonically_increasing_id()))
    number = lambda c, end: nodes.select(*SNAP, F.col("key").alias(c), F.col("id").alias(end))
    ends = pairs.join(number("from_key", "src"), [*SNAP, "from_key"]).join(number("to_key", "dst"), [*SNAP, "to_key"])
    return with_keys(cycles_of(ends.select(F.xxhash64(*SNAP).alias("g"), "src", "dst"), max_len), nodes)


def with_keys(cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """cycles_of with the keys of nodes (id, SNAP, key), turned to begin and end with the least."""
    keyed = cut(cycles.withColumn("nth", F.monotonically_increasing_id())).select("nth", F.posexplode("ids").alias("i", "id")).join(nodes.select("id", *SNAP, "key"), "id")
    rings = keyed.groupBy(*SNAP, "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "key"))), lambda x: x["key"]).alias("k"))
    at, size = F.array_position("k", F.array_min("k")).cast("int"), F.size("k")
    turned = F.concat(F.slice("k", at, size), F.slice("k", F.lit(1), at - 1), F.array(F.array_min("k")))
    return rings.select(*SNAP, turned.alias("cycle")).withColumn("length", F.size("cycle") - 1)


#: Words of 64 bits that tell where ways back to a node can come from.
WORDS = 4


def cycles_of(pairs: DataFrame, max_len: int = 5) -> DataFrame:
    """G7 on numbers. (ids): simple cycles of up to max_len edges, each once, as an array of ids. pairs: (g, src, dst),
    distinct; no edge leaves its group g.

    Ends without a way in or out go first, as long as it pays. Nodes are ranked by degree, and a cycle is found from its
    least rank, so no path starts in a hub that could start elsewhere. A cycle of n edges is a path of ceil(n / 2) edges
    from there that meets a path of floor(n / 2) edges back, so paths grow to half of max_len only, and no cycle is found
    twice. Most paths ahead meet none: each carries some bits, the hashes of the nodes from which its start is reached
    by the longest paths back, and the last step ahead goes only where they allow it. A false bit costs a row; no cycle
    is lost."""
    loops = pairs.filter("src = dst").select(F.array("src").alias("ids"))
    core, _, few = S.trimmed(*cut_and_count(pairs.filter("src != dst")))
    core = core.unionByName(few).select("src", "dst")
    degree = core.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranks = cut(degree.orderBy("degree", "id").select("id", F.monotonically_increasing_id().alias("rank")))
    rank = lambda c: ranks.select(F.col("id").alias(c), F.col("rank").alias(f"{c}_rank"))
    core = cut(core.join(rank("src"), "src").join(rank("dst"), "dst").select(F.col("src_rank").alias("src"), F.col("dst_rank").alias("dst")))
    out = core.select(F.col("src").alias("end"), F.col("dst").alias("next"))
    back = core.select(F.col("dst").alias("end"), F.col("src").alias("next"))
    nodes_of = lambda n: [f"n{i}" for i in range(1, n + 1)]

    def grow(paths: DataFrame, by: DataFrame, n: int, *more) -> DataFrame:
        """Paths (least, n1 .. n<n>, ...) one edge longer; the last node is the end."""
        fresh = F.col("next") > F.col("least")
        for c in nodes_of(n - 1):
            fresh = fresh & (F.col("next") != F.col(c))
        for condition in more:
            fresh = fresh & condition
        longer = paths.withColumnRenamed(f"n{n}", "end").join(by, "end").filter(fresh)
        return longer.select("least", *nodes_of(n - 1), F.col("end").alias(f"n{n}"), F.col("next").alias(f"n{n + 1}"))

    first = lambda a, b: core.filter(f"{a} < {b}").select(F.col(a).alias("least"), F.col(b).alias("n1"))
    ahead, behind, found = first("src", "dst"), first("dst", "src"), []
    a = b = 1
    for n in range(2, max_len + 1):
        if n > 2 and n % 2:
            if n == max_len and n > 3:  # the last step of all, which only paths back of b edges meet
                word = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS))
                marks = behind.select("least", word(f"n{b}").alias("bit"))
                masks = marks.groupBy("least").agg(*(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(WORDS)))
                ahead = ahead.join(masks, "least")  # a start that no path back of b edges reaches has no cycle of this length
                at = word("next")
                mask = F.when(at < 64, F.col("m0"))
                for w in range(1, WORDS):
                    mask = mask.when(at < 64 * (w + 1), F.col(f"m{w}"))
                hit = mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))) != 0
                ahead = grow(ahead.select("least", *nodes_of(a), *(f"m{w}" for w in range(WORDS))), out, a, hit)
            else:
                ahead = grow(ahead, out, a)
            a, ahead = a + 1, cut(ahead)
        elif n > 2:
            b, behind = b + 1, cut(grow(behind, back, b))
        q = [f"q{i}" for i in range(1, b)]
        met = ahead.join(behind.select("least", *(F.col(f"n{i}").alias(f"q{i}") for i in range(1, b)), F.col(f"n{b}").alias(f"n{a}")), ["least", f"n{a}"])
        for x in q:
            for y in nodes_of(a - 1):
                met = met.filter(F.col(x) != F.col(y))
        found.append(cut(met.select(F.array("least", *nodes_of(a), *reversed(q)).alias("ranks"))))
    ids = found[0]
    for more in found[1:]:
        ids = ids.unionByName(more)
    ids = cut(ids.withColumn("nth", F.monotonically_increasing_id()))
    ids = ids.select("nth", F.posexplode("ranks").alias("i", "rank")).join(ranks, "rank").groupBy("nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))
    return ids.select("ids").unionByName(loops)


def cycle_groups(edges: DataFrame) -> DataFrame:
    """G7. SNAP + component, size: the strongly connected components that hold a cycle, of any length."""
    groups = S.scc(edges).groupBy(*SNAP, "component").agg(F.count(F.lit(1)).alias("size"))
    loops = edges.filter("from_key = to_key").select(*SNAP, F.col("from_key").alias("component"), F.lit(True).alias("loop")).distinct()
    return groups.join(loops, [*SNAP, "component"], "left").filter("size > 1 or loop").select(*SNAP, "component", "size")


def new_cycles(old: DataFrame, new: DataFrame, max_len: int = 5) -> DataFrame:
    """G8. Cycles of new that use a (from, to) pair that old lacks; both hold one snapshot of each repo."""
    added = new.select("repo", "from_key", "to_key").distinct().join(old.select("repo", "from_key", "to_key").distinct(), ["repo", "from_key", "to_key"], "left_anti")
    cycles = simple_cycles(new, max_len)
    used = cycles.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("length") - 1))).select("*", F.get("cycle", F.col("i")).alias("from_key"), F.get("cycle", F.col("i") + 1).alias("to_key"))
    hit = used.join(added, ["repo", "from_key", "to_key"], "left_semi").select(*SNAP, "cycle").distinct()
    return cycles.join(hit, [*SNAP, "cycle"], "left_semi")


def _top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*SNAP).orderBy(*order))).filter(F.col("rank") <= n)


def top_by_degree(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """G9. Known nodes by in and out degree; a self loop counts twice."""
    ends = edges.select(*SNAP, F.explode(F.array("from_key", "to_key")).alias("key"))
    degree = ends.groupBy(*SNAP, "key").agg(F.count(F.lit(1)).alias("degree"))
    return _top(degree.join(nodes.select(*SNAP, "key", "symbol", "path"), [*SNAP, "key"]), n, F.col("degree").desc(), "key")


def top_dependencies(nodes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """G10. Sources by out-degree; a source without a node stays."""
    out = edges.groupBy(*SNAP, F.col("from_key").alias("key")).agg(F.count(F.lit(1)).alias("dependencies"))
    return _top(_place(out, nodes), n, F.col("dependencies").desc(), "key")


def first_line(content: Column) -> Column:
    return F.get(F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def diff_nodes(a: DataFrame, b: DataFrame, hash_col: str = "semantic_hash") -> DataFrame:
    """G11. (repo, key, change, symbol, summary) from snapshot a to snapshot b."""
    side = lambda df, s: df.select("repo", "key", F.col("symbol").alias(f"symbol{s}"), F.col("content").alias(f"content{s}"), F.col(hash_col).alias(f"hash{s}"), F.lit(True).alias(f"in{s}"))
    both = side(a, 0).join(side(b, 1), ["repo", "key"], "full_outer")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("hash0").eqNullSafe(F.col("hash1")), "changed")
    pick = lambda c: F.when(F.col("in1").isNull(), F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    return both.withColumn("change", change).filter("change is not null").select("repo", "key", "change", pick("symbol").alias("symbol"), first_line(pick("content")).alias("summary"))


def diff_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """G12. (repo, from_key, to_key, type, change): one row for each edge that only one of both has."""
    ids = ["repo", "from_key", "to_key", "type"]
    only = lambda x, y, what: x.select(*ids).distinct().join(y.select(*ids), ids, "left_anti").withColumn("change", F.lit(what))
    return only(b, a, "added").unionByName(only(a, b, "removed"))


def edge_history_lookup(history: DataFrame, edges: DataFrame, pairs: DataFrame, now: Column, as_of: Column | None = None) -> DataFrame:
    """G13. For each pair (repo, from_key, to_key): its history rows, whether it exists now, and its age in days. Without
    as_of the live rows, or the newest one if none is live; with it, the rows introduced by then."""
    ids = ["repo", "from_key", "to_key"]
    rows = history.join(pairs.select(*ids), ids, "left_semi")
    w = Window.partitionBy(*ids)
    if as_of is not None:
        rows = rows.filter(F.col("introduced_at") <= as_of)
    else:
        rows = rows.withColumn("_any", F.max("live").over(w)).withColumn("_rank", F.row_number().over(w.orderBy(F.col("introduced_at").desc(), "type")))
        rows = rows.filter(F.when(F.col("_any"), F.col("live")).otherwise(F.col("_rank") == 1)).drop("_any", "_rank")
    here = edges.select(*ids).distinct().withColumn("_here", F.lit(True))
    return rows.join(here, ids, "left").withColumn("exists_now", F.coalesce("_here", F.lit(False))).withColumn("age_days", F.datediff(now, F.col("introduced_at"))).drop("_here")


def classify_impact(items: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G15. The first class that fits each impact item, with its reason."""
    ends = lambda df: df.select(*SNAP, F.explode(F.array("from_key", "to_key")).alias("key")).distinct()
    api = ends(edges.filter(F.col("type").isin(*API_TYPES))).withColumn("_api", F.lit(True))
    stores = nodes.filter(C.is_storage_path(F.col("path"))).select(*SNAP, "key")
    uses = edges.filter(F.col("type").isin(*STORAGE_TYPES))
    near = uses.join(stores.withColumnRenamed("key", "to_key"), [*SNAP, "to_key"], "left_semi").unionByName(uses.join(stores.withColumnRenamed("key", "from_key"), [*SNAP, "from_key"], "left_semi"))
    out = items.join(api, [*SNAP, "key"], "left").join(ends(near).withColumn("_store", F.lit(True)), [*SNAP, "key"], "left")
    test, store = C.is_test_path(F.col("path")), C.is_storage_path(F.col("path"))
    kind = F.when(test, "test").when(F.col("_api"), "api-contract").when(F.col("_store") | store, "database-entity").otherwise("other")
    reason = (
        F.when(test, "matched test path convention").when(F.col("_api"), "participates in InvokesEndpoint/Publishes/Consumes edge")
        .when(F.col("_store"), "depends on storage infrastructure via Injected/FieldDependency edge")
        .when(store, "matched entity/model/repository path convention").otherwise("no convention matched")
    )
    return out.withColumns({"classification": kind, "reason": reason}).drop("_api", "_store")


def impact_report(nodes: DataFrame, edges: DataFrame, starts: DataFrame, max_depth: int = 10) -> DataFrame:
    """G14. Counts and rating for each source; all sources are searched at once, 64 to a word, and no row is made for a
    source and a node."""
    sources = in_words(starts.select(*SNAP, "source").distinct().sortWithinPartitions(*SNAP), 64)
    levels, names = bit_search(edges, sources.select(*SNAP, F.col("source").alias("key"), "word", F.col("nth").alias("bit")), max_depth, reverse=True)
    classes = classify_impact(_place(names, nodes), nodes, edges).select("id", "classification")
    found = counts_of(levels.join(classes, "id"), ["depth", "classification"], [1 << b for b in range(64)]).join(sources, ["word", "nth"])
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    out = found.groupBy(*SNAP, "source").agg(
        F.sum("n").cast("long").alias("total"), count(F.col("depth") == 1).alias("direct"), count(F.col("depth") > 1).alias("indirect"), F.max("depth").alias("max_depth"),
        *(count(F.col("classification") == k).alias(k.replace("-", "_")) for k in ("test", "api-contract", "database-entity", "other")),
    )
    out = starts.select(*SNAP, "source").distinct().join(out, [*SNAP, "source"], "left").na.fill(0)
    score = 2 * F.col("direct") + F.col("indirect") + F.col("max_depth")
    rating = F.when((score >= 80) | (F.col("max_depth") >= 8), "CRITICAL").when(score >= 30, "HIGH").when(score >= 8, "MEDIUM").otherwise("LOW")
    return out.withColumn("rating", rating)


def search_nodes(nodes: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """G16. Term as a case-insensitive LIKE pattern inside path, key, symbol or kind; a blank term finds nothing. The limit
    holds for each snapshot."""
    term = (term or "").strip()
    if not term:
        return nodes.filter(F.lit(False))
    hit = F.lit(False)
    for c in ("path", "key", "symbol", "kind"):
        hit = hit | F.col(c).ilike(f"%{term}%")
    rank = F.row_number().over(Window.partitionBy(*SNAP).orderBy("path", "start_line", "key"))
    return nodes.filter(hit).withColumn("_rank", rank).filter(F.col("_rank") <= max(1, min(200, limit))).drop("_rank")


def visible_graph(nodes: DataFrame, edges: DataFrame, module: str | None = None, hide_tests: bool = False, tier: str | None = None, types: tuple[str, ...] = (), source: str | None = None, edge_tier: str | None = None):
    """G17. (nodes, edges, containers) that pass the filters; both ends of an edge must be visible."""
    n = nodes.withColumns(C.classify_node(F.col("model"), F.col("confidence"), F.col("review_status")))
    n = n.filter(F.lower("path").startswith(module.lower())) if module else n
    n = n.filter(~C.is_test_path(F.col("path"))) if hide_tests else n
    n = n.filter(F.col("tier") == tier) if tier else n
    e = edges.withColumns(C.classify_edge(F.col("is_static"), F.col("confidence"))).filter(_wanted(source, edge_tier, "evidence_class"))
    e = within(e.filter(F.col("type").isin(*types)) if types else e, n)
    return n, e, e.filter(F.col("type") == "HasMethod").select(*SNAP, F.col("from_key").alias("key")).distinct()


def facets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G18. SNAP + facet, value, n: modules, kinds and edge types."""
    count = lambda df, name, c: df.groupBy(*SNAP, c.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(*SNAP, F.lit(name).alias("facet"), "value", "n")
    return count(nodes, "module", C.module_of(F.col("path"))).unionByName(count(nodes, "kind", F.col("kind"))).unionByName(count(edges, "type", F.col("type")))
