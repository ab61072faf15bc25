"""Change detection, composition, hashes and history of snapshots (M)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions.tables import Pile, cut, cut_and_count, held
from lattice.operators import quality
from lattice.operators.retrieval import few

SNAP = ["repo", "commit_sha"]
#: Edges of a graph that tasks may solve in memory, in all.
SMALL = 100_000
PENDING, RULE_BASED = "// analysis pending", "rule-based"


def detect_changes(entities: DataFrame, previous: DataFrame, full: bool, flag_ai: bool, flag_static: bool, prompt_version: str = "0.1.0") -> DataFrame:
    """M1. entities with changed, needs_ai, needs_static; previous holds one snapshot of each repo."""
    old = previous.select("repo", "key", F.col("structural_hash").alias("_h"), F.col("model").alias("_m"), F.col("content").alias("_c"), F.col("prompt_version").alias("_v"), F.lit(True).alias("_in"))
    rows = entities.join(old, ["repo", "key"], "left")
    changed = F.col("_in").isNull() | ~F.col("structural_hash").eqNullSafe(F.col("_h"))
    empty = F.coalesce(F.trim("_c"), F.lit("")).isin("", PENDING)
    lacks_static = F.col("_in").isNull() | empty
    lacks_ai = lacks_static | F.col("_m").isNull() | (F.lower("_m") == RULE_BASED) | ~F.col("_v").eqNullSafe(F.lit(prompt_version))
    ai = F.lit(flag_ai) & (F.lit(full) | changed | lacks_ai)
    static = ~ai & F.lit(flag_static) & (F.lit(full) | changed | lacks_static)
    return rows.withColumns({"changed": changed, "needs_ai": ai, "needs_static": static}).drop("_h", "_m", "_c", "_v", "_in")


#: What a node takes over from its previous version.
CARRIED = ("content", "class_diagram", "sequence_diagram", "confidence", "review_status", "model", "prompt_version", "analysed_at")


def compose_nodes(entities: DataFrame, summaries: DataFrame, previous: DataFrame) -> DataFrame:
    """M2. A new summary if there is one, else the previous node's, else pending content. Both tables have the CARRIED
    columns (review_status of a new summary is none)."""
    new = summaries.select("repo", "key", F.struct(*CARRIED).alias("_new"))
    old = previous.select("repo", "key", F.struct(*CARRIED).alias("_old"))
    rows = entities.join(new, ["repo", "key"], "left").join(old, ["repo", "key"], "left")
    default = {"content": F.lit(PENDING), "confidence": F.lit(0.0), "review_status": F.lit("none")}
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(default.get(c, F.lit(None)))
    return rows.withColumns({c: pick(c) for c in CARRIED}).drop("_new", "_old")


def compose_edges(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """M3. De-duplicated relationships whose two ends exist."""
    out = quality.dedupe_edges(rels)
    for end in ("from_key", "to_key"):
        out = out.join(nodes.select(*SNAP, F.col("key").alias(end)), [*SNAP, end], "left_semi")
    return out


def _ranks(left: DataFrame) -> DataFrame:
    """(id, own): a number for each end of an edge, the smaller the better connected. ids are below 2 ** 54."""
    count = lambda end, name: left.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
    degree = count("src", "o").join(count("dst", "i"), "id", "full_outer").na.fill(0)
    step = F.least(F.lit(511), F.floor(8 * F.log2(1 + F.least("o", "i").cast("double")))).cast("long")
    return cut(degree.select("id", (F.shiftleft(F.lit(511) - step, 54) + F.col("id")).alias("own")))


def _least_reached(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(id, own, label): the least rank of a node that reaches id over pairs (src, dst), which are held by src. Only
    labels that changed in a round go on in the next."""
    labels = cut(ranks.select("id", "own", F.col("own").alias("label"), F.lit(True).alias("moved")))
    while True:
        came = pairs.join(labels.filter("moved").select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("m"))
        nxt = labels.join(came, "id", "left").select("id", "own", F.least("label", "m").alias("label"), F.coalesce(F.col("m") < F.col("label"), F.lit(False)).alias("moved"))
        labels, moved = cut_and_count(nxt, F.col("moved"))
        if not moved:
            return labels.drop("moved")


def trimmed(left: DataFrame, now: int) -> tuple[DataFrame, int, DataFrame]:
    """(edges, their number, few): edges (g, src, dst) without the nodes that have no way in or no way out, taken away round
    by round, in each group as long as it pays there; what stays costs time, not results. So a dense group is not read
    again for a thin one, which is trimmed to its core. few holds the edges of the groups that were still worth it when no
    more than SMALL edges of such groups were left."""
    on, stay, n = left, [], now
    while n > SMALL:
        # nodes with both ways are few numbers beside the edges, so edges are probed and not sorted
        both = cut(on.select(F.col("src").alias("id")).distinct().join(on.select(F.col("dst").alias("id")).distinct(), "id"))
        keep = lambda end: both.select(F.col("id").alias(end)).hint("shuffle_hash")  # noqa: E731, B023
        after = cut(on.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi").select("g", "src", "dst"))
        count = lambda df, name: df.groupBy("g").agg(F.count(F.lit(1)).alias(name))
        pays = cut(count(on, "n").join(count(after, "m"), "g").filter("m < 0.95 * n").select("g", "m"))
        n = pays.agg(F.sum("m")).first()[0] or 0
        stay.append(after.join(pays, "g", "left_anti"))
        on = after.join(pays, "g", "left_semi")
    few = cut(on) if stay else on
    if not stay:
        return left.limit(0), 0, few
    for more in stay[1:]:
        stay[0] = stay[0].unionByName(more)
    return *cut_and_count(stay[0]), few


def _chains(left: DataFrame, now: int) -> tuple[DataFrame, int, DataFrame, DataFrame] | None:
    """Shortcuts over nodes with one way in and one way out, or None if few edges join two of them.

    (edges, their number, chains (id, start, stop), rings (id, c)): pointers ahead and back double their reach each
    round, so a chain of n nodes takes log n rounds. It becomes an edge from the node before to the node after; nodes
    whose pointers never leave the chain form a ring, named by its least node."""
    out = left.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("ahead")).filter("n = 1").select(F.col("src").alias("id"), "ahead")
    back = left.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("back")).filter("n = 1").select(F.col("dst").alias("id"), "back")
    links, n = cut_and_count(out.join(back, "id").withColumn("low", F.col("id")))
    if n < 0.2 * now:  # an edge between two of them is the only way out of its first
        return None
    ids = links.select("id")
    inner = left.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").count()
    if inner < 0.2 * now:
        return None
    reach, now = 1, links
    while True:
        far = now.select(F.col("id").alias("ahead"), F.col("ahead").alias("a2"), F.col("low").alias("l2"))
        near = now.select(F.col("id").alias("back"), F.col("back").alias("b2"))
        step = now.join(far, "ahead", "left").join(near, "back", "left")
        step = step.select("id", F.coalesce("a2", "ahead").alias("ahead"), F.coalesce("b2", "back").alias("back"), F.least("low", "l2").alias("low"), (F.col("a2").isNotNull() | F.col("b2").isNotNull()).alias("on"))
        now, on = cut_and_count(step, F.col("on"))
        now, reach = now.drop("on"), 2 * reach
        if not on or reach > 2 * n:
            break
    free = now.join(ids.withColumnRenamed("id", "ahead"), "ahead", "left_anti")
    chains = cut(free.select("id", F.col("back").alias("start"), F.col("ahead").alias("stop")))
    rings = cut(now.join(ids.withColumnRenamed("id", "ahead"), "ahead", "left_semi").select("id", F.col("low").alias("c")))
    group = left.select(F.col("src").alias("start"), "g").distinct()
    rest = left.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    short = chains.filter("start != stop").select("start", "stop").distinct().join(group, "start").select("g", F.col("start").alias("src"), F.col("stop").alias("dst"))
    return *cut_and_count(rest.unionByName(short).distinct()), chains, rings


def _in_tasks(left: DataFrame) -> DataFrame:
    """(id, c) of components with several nodes, each group (g, src, dst) of edges in one task: for few edges, counted."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[int, list[int]] = {}
        back: dict[int, list[int]] = {}
        for a, b in zip(frame["src"].tolist(), frame["dst"].tolist()):
            ahead.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
        ended, seen = [], set()  # nodes by the time at which a walk ahead leaves them
        for root in ahead:
            walk = [] if root in seen else [(root, iter(ahead[root]))]
            seen.add(root)
            while walk:
                to = next((x for x in walk[-1][1] if x not in seen), None)
                if to is None:
                    ended.append(walk.pop()[0])
                else:
                    seen.add(to)
                    walk.append((to, iter(ahead.get(to, ()))))
        rows, placed = [], set()
        for root in reversed(ended):  # what reaches a root back among the nodes not placed yet is its component
            mine = [] if root in placed else [root]
            placed.add(root)
            for x in mine:
                for y in back.get(x, ()):
                    if y not in placed:
                        placed.add(y)
                        mine.append(y)
            rows += [(x, root) for x in mine if len(mine) > 1]
        return pd.DataFrame(rows, columns=["id", "c"]).astype("int64")

    return left.groupBy("g").applyInPandas(solve, "id long, c long")


def _components(pairs: DataFrame) -> DataFrame:
    """(id, c) of the nodes whose strongly connected component has several, c naming it. pairs: (g, src, dst), distinct
    whole numbers below 2 ** 54; no edge leaves its group g.

    Trimming first takes away what cannot be on a cycle; chains are cut short, with rounds in the logarithm of their
    length. What is left goes by colours: each node takes the label of the best connected node that reaches it; inside a
    label the nodes that reach the label's own node are its component. So the large components of all groups, and of all
    separate parts of a group, go in the first round, and each round finishes at least one component per label. Edges are
    dealt by the end that a search starts from and held for its rounds, which then shuffle only what moves. Once no more
    than SMALL edges are left, tasks finish the groups.
    """
    left, now, few = trimmed(*cut_and_count(pairs.filter("src != dst")))
    done = Pile(cut(_in_tasks(few)))
    short = _chains(left, now) if now > SMALL else None
    if short:
        left, now, chains, rings = short
        done.add(rings)
        left, now, few = trimmed(left, now)
        done.add(cut(_in_tasks(few)))
    while now:
        if now <= SMALL:
            done.add(cut(_in_tasks(left)))
            break
        with held(left, "src", now) as ahead:
            forward = _least_reached(ahead, _ranks(left))
        colour = lambda c, name: forward.select(F.col("id").alias(c), F.col("label").alias(name)).hint("shuffle_hash")  # noqa: E731, B023
        same, now = cut_and_count(left.join(colour("src", "c"), "src").join(colour("dst", "d"), "dst").filter("c = d").select("g", "src", "dst"))
        # backward from the label's own node, inside the colour
        front = cut(forward.filter("own = label").select("id", F.col("id").alias("c")))
        reached = Pile(front)
        with held(same, "dst", now) as back:
            while True:
                step = back.join(front.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
                front, n = cut_and_count(step.join(reached.all().select("id"), "id", "left_anti"))
                if not n:
                    break
                reached.add(front)
        found = cut(reached.all())
        done.add(found)
        out = lambda end: found.select(F.col("id").alias(end)).hint("shuffle_hash")  # noqa: E731, B023
        left, now, few = trimmed(*cut_and_count(same.join(out("src"), "src", "left_anti").join(out("dst"), "dst", "left_anti").select("g", "src", "dst")))
        done.add(cut(_in_tasks(few)))
    solved = done.all()
    if short:  # a chain belongs to a component if both its ends do, or are one node
        place = lambda end, name: solved.select(F.col("id").alias(end), F.col("c").alias(name))
        ends = chains.join(place("start", "cs"), "start", "left").join(place("stop", "ce"), "stop", "left")
        ends = ends.withColumns({"cs": F.coalesce("cs", "start"), "ce": F.coalesce("ce", "stop")}).filter("cs = ce")
        solved = solved.unionByName(ends.select("id", F.col("cs").alias("c"))).unionByName(ends.select(F.col("start").alias("id"), F.col("cs").alias("c"))).distinct()
    several = solved.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c")
    return solved.join(several, "c", "left_semi").select("id", "c")


def components(pairs: DataFrame) -> DataFrame:
    """M4 on numbers. (id, c) of the nodes whose component has several; pairs: (g, src, dst), no edge leaving its group g."""
    return cut(_components(pairs.distinct()))


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes with an id, a whole number; written, so that it stays."""
    return cut(nodes.withColumn("id", F.monotonically_increasing_id()))


def scc(edges: DataFrame) -> DataFrame:
    """M4. SNAP, key, component (its least key) for every end of an edge. The search runs on numbers; keys come back at
    the end."""
    pairs = edges.select(*SNAP, F.col("from_key").alias("src"), F.col("to_key").alias("dst")).distinct()
    nodes = _numbered(pairs.select(*SNAP, F.explode(F.array("src", "dst")).alias("key")).distinct())
    side = lambda c: nodes.select(*SNAP, F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    return scc_of(pairs.join(side("src"), [*SNAP, "src"]).join(side("dst"), [*SNAP, "dst"]).select(F.xxhash64(*SNAP).alias("g"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), nodes)


def scc_of(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """M4 of a numbered graph: pairs (g, src, dst), distinct; nodes (id, SNAP, key)."""
    placed = nodes.join(_components(pairs), "id", "left")
    least = placed.filter("c is not null").groupBy("c").agg(F.min("key").alias("least"))
    return placed.join(least, "c", "left").select(*SNAP, "key", F.coalesce("least", "key").alias("component"))


def _framed(*parts: Column) -> Column:
    """Length-prefixed text of parts, so that no two lists of parts look alike."""
    return F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))


def semantic_hash(nodes: DataFrame, edges: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """M5. SNAP, key, semantic_hash: content plus the children by key, type and hash, dependencies first.

    Inside a cycle a member's local hash has its outside children with hashes and its inside children by key and type;
    the component's digest hashes the sorted locals; a member hashes its local and the digest. So a change in one member
    reaches all, and a change anywhere reaches every ancestor. overrides (SNAP, key, semantic_hash) are taken as known.
    """
    own = _numbered(nodes.select(*SNAP, "key", F.coalesce("content", F.lit("")).alias("content")))
    side = lambda c, name: own.select(*SNAP, F.col("key").alias(c), F.col("id").alias(name))
    e = edges.select(*SNAP, "from_key", "to_key", "type").distinct().join(side("from_key", "f"), [*SNAP, "from_key"]).join(side("to_key", "t"), [*SNAP, "to_key"])
    return semantic_hash_of(own, cut(e.select(F.xxhash64(*SNAP).alias("g"), "f", "t", "type")), overrides)


def semantic_hash_of(own: DataFrame, e: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """M5 of a numbered graph, both tables written: own (id, SNAP, key, content), edges (g, f, t, type), distinct.

    The level of a component is the longest way down from it. Levels are found on numbers alone, over the edges between
    components. Nodes and edges are then sorted by level, so that a level reads its own rows: it hashes its nodes, and its
    hashes go up the edges as messages, which are kept. So each text is read and each edge followed once. When no more
    than SMALL components wait for a level, with rows and texts in proportion, each snapshot's rest is hashed in one task,
    level by level there: a long thin rest has many levels of few nodes.
    """
    parts = cut(_components(e.select("g", F.col("f").alias("src"), F.col("t").alias("dst")).distinct()))
    place = lambda c, name: parts.select(F.col("id").alias(c), F.col("c").alias(name))
    e = e.join(place("f", "cf"), "f", "left").join(place("t", "ct"), "t", "left")
    e = cut(e.select("f", "t", "type", F.coalesce("cf", "f").alias("cf"), F.coalesce("ct", "t").alias("ct")))
    inside, out = e.filter("cf = ct"), e.filter("cf != ct")
    looped = inside.select(F.col("cf").alias("c")).distinct().withColumn("loop", F.lit(True))
    todo = own.join(parts, "id", "left").withColumn("c", F.coalesce("c", "id")).join(looped, "c", "left").withColumn("loop", F.coalesce("loop", F.lit(False)))
    if overrides is not None:
        todo = todo.join(overrides.select(*SNAP, "key"), [*SNAP, "key"], "left_anti")
    todo = cut(todo)
    levels, n = _levels(todo, e, overrides is not None)
    level = lambda c, name: levels.select(F.col("c").alias(c), F.col("level").alias(name))
    sort = lambda df, by: cut(df.repartitionByRange(by, "id").sortWithinPartitions(by))
    out = out.join(level("cf", "level"), "cf", "left").join(level("ct", "below"), "ct", "left")  # no level: overridden as a whole
    out = sort(out.select("cf", "f", F.col("t").alias("id"), "type", "level", F.coalesce("below", F.lit(-1)).alias("below")), "below")
    inside = sort(inside.join(level("cf", "level"), "cf").select("f", F.col("t").alias("id"), "type", "level"), "level")
    todo = sort(todo.join(level("c", "level"), "c"), "level")
    part = lambda h: _framed(F.col("key"), F.col("type"), h)

    def send(edges: DataFrame, new: DataFrame) -> DataFrame:
        up = edges.filter("level is not null").join(new.select("id", "key", "semantic_hash"), "id")
        return cut(up.select("level", F.col("f").alias("id"), part(F.col("semantic_hash")).alias("part")))

    told, done = Pile(), Pile()
    if overrides is not None:
        known = cut(overrides.select(*SNAP, "key", "semantic_hash").join(own.select(*SNAP, "key", "id"), [*SNAP, "key"], "left"))
        done.add(known.drop("id"))
        told.add(send(out, known))
    named = own.select("id", "key")
    for at in range(n):
        ready = todo.filter(F.col("level") == at)
        among = inside.filter(F.col("level") == at).join(named, "id").select(F.col("f").alias("id"), part(F.lit("")).alias("part"))
        came = among.unionByName(told.all().filter(F.col("level") == at).select("id", "part")) if told.scans else among
        lists = came.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("part")), "").alias("kids"))
        local = ready.join(lists, "id", "left").withColumn("local", F.sha2(_framed(F.col("content"), F.coalesce("kids", F.lit(""))), 256))
        local = cut(local.select(*SNAP, "key", "id", "c", "loop", "local"))
        loops = local.filter("loop").groupBy("c").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(_framed(F.col("key"), F.col("local")))), ""), 256).alias("digest"))
        new = local.join(loops, "c", "left")
        new = cut(new.select(*SNAP, "key", "id", F.when(F.col("loop"), F.sha2(_framed(F.col("local"), F.col("digest")), 256)).otherwise(F.col("local")).alias("semantic_hash")))
        done.add(new.drop("id"))
        told.add(send(out.filter(F.col("below") == at), new))
    late = todo.filter(F.col("level") == REST)
    none = {k: F.lit(v) for k, v in (("c", -1), ("other", -1), ("key", ""), ("loop", False))}  # no nulls: whole numbers stay whole
    of_snap = late.select(*SNAP, "id")
    rest = late.select(*SNAP, F.lit(0).alias("kind"), "c", "id", none["other"].cast("long").alias("other"), "key", "content", "loop")
    among = inside.filter(F.col("level") == REST).join(named, "id").select(F.col("f").alias("id"), part(F.lit("")).alias("part"))
    came = among.unionByName(told.all().filter(F.col("level") == REST).select("id", "part")) if told.scans else among
    rest = rest.unionByName(came.join(of_snap, "id").select(*SNAP, F.lit(1).alias("kind"), none["c"].cast("long").alias("c"), "id", none["other"].cast("long").alias("other"), none["key"].alias("key"), F.col("part").alias("content"), none["loop"].alias("loop")))
    between = out.filter(F.col("below") == REST).join(late.select(*SNAP, "id", "key"), "id")
    rest = cut(rest.unionByName(between.select(*SNAP, F.lit(2).alias("kind"), F.col("cf").alias("c"), F.col("f").alias("id"), F.col("id").alias("other"), "key", F.col("type").alias("content"), none["loop"].alias("loop"))))
    done.add(cut(_hash_in_tasks(rest)))
    return done.all()


#: The level of what tasks hash in the end.
REST = -2


def _levels(todo: DataFrame, e: DataFrame, known: bool) -> tuple[DataFrame, int]:
    """(c, level) of the components of todo, and how many levels have been found: what is left has REST, and is so little
    that a task can hold it. Edges into nodes that are not in todo, of which there are some if known, hold nobody up."""
    most_key, most_type = todo.agg(F.max(F.length("key"))).first()[0] or 0, e.agg(F.max(F.length("type"))).first()[0] or 0
    size = todo.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("content")).cast("long").alias("chars"))
    size = size.join(e.groupBy(F.col("cf").alias("c")).agg(F.count(F.lit(1)).alias("k")), "c", "left").na.fill(0, ["k"])
    wide = F.col("k") * (most_key + most_type + 100)  # a message has a hash, a key, a type and their lengths
    size = size.select("c", (F.col("rows") + F.col("k")).alias("rows"), (F.col("chars") + wide).alias("chars"))
    dag = e.filter("cf != ct")
    if known:
        dag = dag.join(todo.select(F.col("id").alias("t")), "t", "left_semi")
    dag = dag.select("cf", "ct").distinct()
    dag = cut(dag.join(todo.select(F.col("c").alias("cf")).distinct(), "cf", "left_semi"))
    waits = size.join(dag.groupBy(F.col("cf").alias("c")).agg(F.count(F.lit(1)).alias("n")), "c", "left").na.fill(0, ["n"])
    found, at, before = Pile(), 0, None
    waiting = F.col("n") > 0
    while True:
        waits = cut(waits)
        open_, rows, chars = waits.filter(waiting).agg(F.count(F.lit(1)), F.sum("rows"), F.sum("chars")).first()
        ready = waits.filter("n = 0").select("c", F.lit(at).alias("level"))
        found.add(ready)
        at += 1
        if not open_ or (open_ <= SMALL and rows <= 10 * SMALL and chars <= 1_000 * SMALL):
            found.add(waits.filter(waiting).select("c", F.lit(REST).alias("level")))
            return cut(found.all()), at
        waits = waits.filter(waiting)
        if before is None or open_ < before // 2:
            before, dag = open_, cut(dag.join(waits.select(F.col("c").alias("cf")), "cf", "left_semi"))
        came = dag.join(ready.select(F.col("c").alias("ct")), "ct").groupBy(F.col("cf").alias("c")).agg(F.count(F.lit(1)).alias("k"))
        waits = waits.join(came, "c", "left").select("c", "rows", "chars", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n"))


def _hash_in_tasks(rest: DataFrame) -> DataFrame:
    """SNAP, key, id, semantic_hash of what waits, each snapshot in one task: for few rows, counted. rest: rows of one
    snapshot each, kind 0 for a node (c, id, key, content, loop), 1 for a message (id, content), 2 for an edge (c, id from,
    other to, key, content: the type)."""
    framed = lambda *parts: "".join(f"{len(p)}:{p}" for p in parts)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        members: dict[int, list] = {}
        parts: dict[int, list[str]] = {}
        up: dict[int, list] = {}
        waits: dict[int, int] = {}
        for r in frame.itertuples(index=False):
            if r.kind == 0:
                members.setdefault(r.c, []).append(r)
                waits.setdefault(r.c, 0)
            elif r.kind == 1:
                parts.setdefault(r.id, []).append(r.content)
            else:
                up.setdefault(r.other, []).append(r)
                waits[r.c] = waits.get(r.c, 0) + 1
        waits = {c: n for c, n in waits.items() if c in members}  # nodes with a known hash have none to come
        ready, rows = [c for c, n in waits.items() if not n], []
        for c in ready:
            local = {r.id: sha(framed(r.content, "".join(sorted(parts.pop(r.id, []))))) for r in members[c]}
            digest = sha("".join(sorted(framed(r.key, local[r.id]) for r in members[c])))
            for r in members[c]:
                h = sha(framed(local[r.id], digest)) if r.loop else local[r.id]
                rows.append((r.repo, r.commit_sha, r.key, h))
                for e in up.get(r.id, ()):
                    if e.c in waits:
                        parts.setdefault(e.id, []).append(framed(e.key, e.content, h))
                        waits[e.c] -= 1
                        if not waits[e.c]:
                            ready.append(e.c)
        return pd.DataFrame(rows, columns=["repo", "commit_sha", "key", "semantic_hash"])

    kinds = {f.name: f.dataType.simpleString() for f in rest.schema}
    return rest.groupBy(*SNAP).applyInPandas(solve, f"repo {kinds['repo']}, commit_sha {kinds['commit_sha']}, key string, semantic_hash string")


def snapshot_root(nodes: DataFrame, hash_col: str = "semantic_hash") -> DataFrame:
    """M6. Root of a snapshot's node hashes: those that begin with the same four hex digits are sorted, joined by newlines
    and hashed; so are these digests by two digits; so are the digests of all. No row gathers a whole snapshot."""
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    four = nodes.groupBy(*SNAP, F.substring(hash_col, 1, 4).alias("four")).agg(digest(hash_col).alias("h"))
    two = four.groupBy(*SNAP, F.substring("four", 1, 2).alias("two")).agg(digest("h").alias("h"))
    return two.groupBy(*SNAP).agg(digest("h").alias("root_hash"))


def provenance(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """M7. A row for each node that has a fresh summary."""
    fresh = summaries.select("repo", "key", F.col("model").alias("_m"), F.col("prompt_version").alias("_v"), F.col("analysed_at").alias("at"))
    return nodes.join(fresh, ["repo", "key"]).select(*SNAP, "key", F.col("_m").alias("model"), F.col("_v").alias("prompt_version"), "at")


def resolve_snapshot(snapshots: DataFrame, commit: str | None = None) -> DataFrame:
    """M8. The latest snapshot of each repo, or the one of a commit."""
    rows = snapshots if commit is None else snapshots.filter(F.col("commit_sha") == commit)
    w = Window.partitionBy("repo").orderBy(F.col("created_at").desc(), F.col("commit_sha").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def require_snapshot(snapshots: DataFrame, repo: str, commit: str | None = None) -> DataFrame:
    """M8. As resolve_snapshot for one repo; a missing snapshot is an error."""
    found = resolve_snapshot(snapshots.filter(F.col("repo") == repo), commit)
    if found.isEmpty():
        raise LookupError(f"no snapshot of {repo} at {commit or 'its latest commit'}")
    return found


def flag_for_review(nodes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """M9. none becomes needs_review below the threshold."""
    return nodes.withColumn("review_status", F.when((F.col("review_status") == "none") & (F.col("confidence") < threshold), "needs_review").otherwise(F.col("review_status")))


def snapshot_headers(nodes: DataFrame, edges: DataFrame, snapshots: DataFrame, hash_col: str = "semantic_hash") -> DataFrame:
    """M10. Root hash, counts and parent commit of each snapshot."""
    count = lambda df, name: df.groupBy(*SNAP).agg(F.count(F.lit(1)).alias(name))
    parent = F.lag("commit_sha").over(Window.partitionBy("repo").orderBy("created_at"))
    out = snapshots.select(*SNAP, "created_at").withColumn("parent_commit", parent)
    out = out.join(snapshot_root(nodes, hash_col), SNAP, "left").join(count(nodes, "node_count"), SNAP, "left").join(count(edges, "edge_count"), SNAP, "left")
    return out.na.fill(0, ["node_count", "edge_count"])


EDGE = ["repo", "from_key", "to_key", "type"]


def edge_history(edges: DataFrame, snapshots: DataFrame) -> DataFrame:
    """M11, all snapshots at once. A row for each unbroken run of snapshots that hold an edge: introducing commit and time,
    and live if the run goes on to the repo's last snapshot (gaps and islands)."""
    numbered = snapshots.select(*SNAP, "created_at", F.row_number().over(Window.partitionBy("repo").orderBy("created_at")).alias("n"))
    numbered = cut(numbered)
    last = few(numbered.groupBy("repo").agg(F.max("n").alias("last")))
    # dealt by edge once, which serves the distinct rows, the window and the groups
    rows = edges.select(*SNAP, "from_key", "to_key", "type").repartition(*EDGE).distinct().join(few(numbered), SNAP)
    w = Window.partitionBy(*EDGE).orderBy("n")
    rows = rows.withColumn("island", F.col("n") - F.row_number().over(w))
    runs = rows.groupBy(*EDGE, "island").agg(F.min_by("commit_sha", "n").alias("introduced_commit"), F.min("created_at").alias("introduced_at"), F.max("n").alias("until"))
    return runs.join(last, "repo").select(*EDGE, "introduced_commit", "introduced_at", (F.col("until") == F.col("last")).alias("live"))


def edge_history_step(history: DataFrame, edges: DataFrame, commit: str, at: Column) -> DataFrame:
    """M11, one snapshot more: edges without a live row open one; live rows whose edge is gone are closed. edges holds the
    new snapshot of the repos that have one; rows of other repos stay."""
    now = edges.select(*EDGE).distinct()
    repos = edges.select("repo").distinct()
    kept = history.join(now.withColumn("_here", F.lit(True)), EDGE, "left").join(repos.withColumn("_new", F.lit(True)), "repo", "left")
    kept = kept.withColumn("live", F.col("live") & (F.col("_here").isNotNull() | F.col("_new").isNull())).drop("_here", "_new")
    opened = now.join(history.filter("live").select(*EDGE), EDGE, "left_anti")
    return kept.unionByName(opened.select(*EDGE, F.lit(commit).alias("introduced_commit"), at.alias("introduced_at"), F.lit(True).alias("live")))
