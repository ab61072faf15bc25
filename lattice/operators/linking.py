"""Linking references to declarations (L). A declaration row: repo, commit_sha, path, ord, name, kind, start, end,
start_line, bases, field_types, injected_types. `ord` is the order in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = ["repo", "commit_sha"]
MEMBERS = ("Method", "Function")


def _last(c: str | Column) -> Column:
    return F.substring_index(c, ".", -1)


def _edge(rows: DataFrame, kind, confidence: float, evidence: Column) -> DataFrame:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return rows.select(*SNAP, "from_key", "to_key", kind.alias("type"), F.lit(float(confidence)).alias("confidence"), evidence.alias("evidence")).filter("from_key != to_key")


#: Outer spans of a file that each inner span is compared with one by one; larger files are cut into blocks.
DIRECT = 64
#: Slices of a file's ends.
SLICES = 256
FILE = [*SNAP, "path"]


def least_around(inner: DataFrame, outer: DataFrame, by: list[str]) -> DataFrame:
    """For each inner span (SNAP, path, `by`, start, end) the least `best` of the outer spans (SNAP, path, s0, e0, best; best
    of any type with an order) of its file that contain it: (SNAP, path, `by`, best). Inner spans that none contains, spans
    with a null start or end and files without a path are left out; spans need not nest, and may be empty or the same.

    In a file of more than DIRECT different outer spans no pair of spans becomes a row, however deep they nest. Outer spans
    are dealt by start to blocks of each power of two, and the starts up to an inner span's own are a union of such blocks,
    at most one a power. A block is ordered by end, and a running least of it answers its inner spans. To keep a large file
    out of one task a block is cut into slices by end: a span meets the spans of its own slice, and the least of each later
    one. n spans over a range of starts r cost n log r rows."""
    spans = outer.filter("s0 is not null and e0 is not null and path is not null").groupBy(*FILE, "s0", "e0").agg(F.min("best").alias("best"))
    inner = inner.select(*FILE, *by, F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e")).filter("s is not null and e is not null")
    size = spans.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"), F.min("s0").cast("long").alias("low"), F.max("s0").cast("long").alias("high"), F.min("e0").cast("long").alias("first"), F.max("e0").cast("long").alias("last"))
    sized = lambda df, large: df.join(size.filter(F.col("n") > DIRECT if large else F.col("n") <= DIRECT), FILE)

    near = sized(inner, False).select(*FILE, *by, "s", "e").join(spans, FILE).filter("s0 <= s and e0 >= e").select(*FILE, *by, "best")

    # numbers of starts are shifted to begin with 0; a span that ends after all others, or starts before, is in none
    slice_of = lambda e: F.expr(f"cast(({e} - first) div ((last - first) div {SLICES} + 1) as int)")
    powers = lambda x, bit: F.explode(F.expr(f"filter(sequence(0, length(bin(high - low + 1)) - 1), b -> (shiftright({x}, b) & 1) = {bit})"))
    held = sized(spans, True).select(*FILE, "best", F.col("e0").cast("long").alias("e"), slice_of("e0").alias("slice"), (F.col("s0") - F.col("low")).alias("x"), powers("(s0 - low)", 0).alias("power"))
    held = held.select(*FILE, "power", F.expr("shiftright(x, power)").alias("block"), "slice", "e", "best")
    asks = sized(inner, True).filter("s >= low and e <= last").withColumns({"s": F.least("s", "high"), "e": F.greatest("e", "first")})
    asks = asks.select(*FILE, *by, "e", slice_of("e").alias("slice"), (F.col("s") - F.col("low") + 1).alias("x"), powers("(s - low + 1)", 1).alias("power"))
    asks = asks.select(*FILE, *by, "power", (F.expr("shiftright(x, power)") - 1).alias("block"), "slice", "e")

    at = [*FILE, "power", "block"]
    w = Window.partitionBy(*at, "slice").orderBy(F.col("e").desc(), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.withColumn("asks", F.lit(False)).unionByName(asks.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    own = both.withColumn("best", F.min("best").over(w)).filter("asks and best is not null").select(*FILE, *by, "best")
    slices = held.groupBy(*at, "slice").agg(F.min("best").alias("best")).groupBy(*at).agg(F.collect_list(F.struct("slice", "best")).alias("slices"))
    later = F.array_min(F.transform(F.filter("slices", lambda x: x["slice"] > F.col("slice")), lambda x: x["best"]))
    later = asks.join(slices, at).select(*FILE, *by, later.alias("best")).filter("best is not null")
    return near.unionByName(own).unionByName(later).groupBy(*FILE, *by).agg(F.min("best").alias("best"))


def assign_owner(decls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L1. (entities, edges): each method's owner is the shortest other declaration of its file that contains it; symbol
    and key follow; the owner has an edge to the method."""
    member = F.col("kind").isin(*MEMBERS)
    best = F.struct((F.col("end") - F.col("start")).alias("span"), F.col("ord").alias("o0"), F.col("name").alias("owner"))
    outer = decls.filter(~member).select(*FILE, F.col("start").alias("s0"), F.col("end").alias("e0"), best.alias("best"))
    owner = least_around(decls.filter(member), outer, ["ord"]).select(*FILE, "ord", F.col("best.owner").alias("owner"))
    rows = decls.join(owner, [*FILE, "ord"], "left")
    rows = rows.withColumn("symbol", F.when(F.col("owner").isNotNull(), F.concat_ws(".", "owner", "name")).otherwise(F.col("name"))).withColumn("key", F.concat("path", F.lit("::"), "symbol"))
    has = rows.filter("owner is not null").withColumn("from_key", F.concat("path", F.lit("::"), "owner")).withColumn("to_key", F.col("key"))
    return rows, _edge(has, "HasMethod", 1.0, F.col("path"))


def assign_call(calls: DataFrame, decls: DataFrame) -> DataFrame:
    """L2. calls (SNAP, path, call, start, end) with the ord of the first method, in declaration order, that contains them."""
    methods = decls.filter(F.col("kind").isin(*MEMBERS)).select(*FILE, F.col("start").alias("s0"), F.col("end").alias("e0"), F.col("ord").alias("best"))
    return least_around(calls, methods, ["call"]).withColumnRenamed("best", "method_ord")


def _named(entities: DataFrame, column: str) -> DataFrame:
    return entities.select(*SNAP, "path", "ord", F.col("key").alias("from_key"), "start_line", F.explode(column).alias("name"))


def _local(entities: DataFrame, column: str) -> DataFrame:
    """Names of a column met with the last entity of that symbol in the same file."""
    own = entities.groupBy(*SNAP, "path", F.col("symbol").alias("name")).agg(F.max_by("key", "ord").alias("to_key"), F.max_by("kind", "ord").alias("to_kind"))
    return _named(entities, column).join(own, [*SNAP, "path", "name"])


def _base_type() -> Column:
    return F.when(F.col("to_kind") == "Interface", "Implements").otherwise("Inherits")


def link_bases_local(entities: DataFrame) -> DataFrame:
    """L3. Bases declared in the same file."""
    return _edge(_local(entities, "bases"), _base_type(), 1.0, F.col("path"))


def link_fields_local(entities: DataFrame) -> DataFrame:
    """L4. Field types declared in the same file."""
    return _edge(_local(entities, "field_types"), "FieldDependency", 0.9, F.concat_ws(":", "path", F.col("start_line").cast("string")))


def link_injected_local(entities: DataFrame) -> DataFrame:
    """L5. Constructor parameter types declared in the same file."""
    return _edge(_local(entities, "injected_types"), "Injected", 0.95, F.concat_ws(":", "path", F.col("start_line").cast("string")))


def _at_call() -> Column:
    return F.concat_ws(":", "path", F.col("line").cast("string"))


def link_calls_local(entities: DataFrame, calls: DataFrame) -> DataFrame:
    """L6. calls (SNAP, path, from_key, callee, line): the callee is a symbol of the file (1.0), else the one entity of the
    file with that last segment (0.8)."""
    full = entities.groupBy(*SNAP, "path", F.col("symbol").alias("callee")).agg(F.max_by("key", "ord").alias("full_key"))
    tail = entities.groupBy(*SNAP, "path", _last("symbol").alias("tail")).agg(F.count_distinct("key").alias("n"), F.min("key").alias("tail_key")).filter("n = 1")
    rows = calls.withColumn("tail", _last("callee")).join(full, [*SNAP, "path", "callee"], "left").join(tail, [*SNAP, "path", "tail"], "left")
    rows = rows.withColumn("to_key", F.coalesce("full_key", "tail_key")).filter("to_key is not null")
    out = rows.select(*SNAP, "from_key", "to_key", F.lit("Calls").alias("type"), F.when(F.col("full_key").isNotNull(), 1.0).otherwise(0.8).alias("confidence"), _at_call().alias("evidence"))
    return out.filter("from_key != to_key")


def symbol_index(entities: DataFrame) -> DataFrame:
    """L7. (SNAP, index, name, keys): last segments and full symbols with their sorted keys."""
    last = entities.select(*SNAP, F.lit("last").alias("index"), _last("symbol").alias("name"), "key")
    full = entities.select(*SNAP, F.lit("full").alias("index"), F.col("symbol").alias("name"), "key")
    return last.unionByName(full).groupBy(*SNAP, "index", "name").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def _unique(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (SNAP, from_key, name, ...) with the only entity, besides from_key itself, of that last segment. What is kept
    of each name is a count and two extremes, so a common name costs no long list."""
    seg = entities.select(*SNAP, _last("symbol").alias("tail"), "key", "kind").dropDuplicates([*SNAP, "key"])
    stat = seg.groupBy(*SNAP, "tail").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "kind")).alias("lo"), F.max(F.struct("key", "kind")).alias("hi"))
    rows = names.withColumn("tail", _last("name")).join(stat, [*SNAP, "tail"])
    self_ = F.col("from_key").isin(F.col("lo.key"), F.col("hi.key"))
    other = F.when(F.col("n") == 1, F.when(F.col("lo.key") != F.col("from_key"), F.col("lo"))).when((F.col("n") == 2) & self_, F.when(F.col("lo.key") == F.col("from_key"), F.col("hi")).otherwise(F.col("lo")))
    return rows.withColumn("o", other).filter("o is not null").withColumns({"to_key": F.col("o.key"), "to_kind": F.col("o.kind")}).drop("o", "lo", "hi", "n", "tail")


def link_calls_global(entities: DataFrame, calls: DataFrame, local_edges: DataFrame) -> DataFrame:
    """L8. Calls to other files: a symbol held once (0.8), else a last segment with one candidate (0.6). A call is skipped
    if its source has a resolved in-file call on the same line."""
    done = local_edges.filter("type = 'Calls'").select(*SNAP, "from_key", "evidence").distinct()
    rows = calls.withColumn("evidence", _at_call()).join(done, [*SNAP, "from_key", "evidence"], "left_anti").withColumn("name", F.col("callee"))
    full = entities.groupBy(*SNAP, F.col("symbol").alias("name")).agg(F.count_distinct("key").alias("n"), F.min("key").alias("full_key")).filter("n = 1").drop("n")
    rows = rows.join(full, [*SNAP, "name"], "left").withColumn("full_key", F.when(F.col("full_key") != F.col("from_key"), F.col("full_key")))
    exact = rows.filter("full_key is not null").withColumn("to_key", F.col("full_key"))
    loose = _unique(rows.filter("full_key is null"), entities)
    return _edge(exact, "Calls", 0.8, F.col("evidence")).unionByName(_edge(loose, "Calls", 0.6, F.col("evidence"))).distinct()


def link_bases_global(entities: DataFrame, local_edges: DataFrame) -> DataFrame:
    """L9. Bases in other files, unless an in-file inheritance edge to the same target exists."""
    done = local_edges.filter("type in ('Inherits', 'Implements')").select(*SNAP, "from_key", "to_key").distinct()
    rows = _unique(_named(entities, "bases"), entities).join(done, [*SNAP, "from_key", "to_key"], "left_anti")
    return _edge(rows, _base_type(), 0.8, F.col("path"))


def link_members(entities: DataFrame) -> DataFrame:
    """L10. Methods of a type and the same-named methods of its unique interface base."""
    base = _unique(_named(entities, "bases"), entities).filter("to_kind = 'Interface'").select(*SNAP, F.col("from_key").alias("type_key"), F.col("to_key").alias("interface_key")).distinct()
    owned = entities.filter("owner is not null").select(*SNAP, F.concat("path", F.lit("::"), "owner").alias("owner_key"), "key", _last("symbol").alias("tail"), "path", "ord")
    mine = owned.select(*SNAP, F.col("owner_key").alias("type_key"), F.col("key").alias("from_key"), "tail", "path")
    theirs = owned.groupBy(*SNAP, F.col("owner_key").alias("interface_key"), "tail").agg(F.min_by("key", "ord").alias("to_key"))
    return _edge(base.join(mine, [*SNAP, "type_key"]).join(theirs, [*SNAP, "interface_key", "tail"]), "Implements", 0.9, F.col("path"))


def link_types_global(entities: DataFrame, local_edges: DataFrame, column: str, kind: str, confidence: float) -> DataFrame:
    """L11. Field (0.7) or constructor types (0.85) in other files, unless the same edge exists in-file."""
    rows = _unique(_named(entities, column), entities)
    edges = _edge(rows, kind, confidence, F.concat_ws(":", "path", F.col("start_line").cast("string")))
    return edges.join(local_edges.select(*SNAP, "from_key", "to_key", "type").distinct(), [*SNAP, "from_key", "to_key", "type"], "left_anti")


def ambiguous_refs(names: DataFrame, entities: DataFrame) -> DataFrame:
    """L12. (SNAP, from_key, name, candidates): names (SNAP, from_key, name) with more than one candidate besides self."""
    index = symbol_index(entities).filter("index = 'last'").select(*SNAP, F.col("name").alias("tail"), "keys")
    rows = names.select(*SNAP, "from_key", "name").distinct().withColumn("tail", _last("name")).join(index, [*SNAP, "tail"])
    rows = rows.withColumn("keys", F.filter("keys", lambda k: k != F.col("from_key"))).filter(F.size("keys") > 1)
    return rows.select(*SNAP, "from_key", "name", F.array_join("keys", ", ").alias("candidates"))


PROPOSALS = "array<struct<from:string,to:string,type:string,evidence:string,confidence:double>>"


def accept_proposals(proposals: DataFrame, entities: DataFrame, rels: DataFrame) -> DataFrame:
    """L13. proposals (SNAP, json): known and different ends, type Calls or InvokesEndpoint, not there yet, distinct."""
    text = F.regexp_replace("json", r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    rows = proposals.select(*SNAP, F.explode(F.from_json(text, PROPOSALS)).alias("p")).select(*SNAP, F.col("p.from").alias("from_key"), F.col("p.to").alias("to_key"), F.col("p.type").alias("type"), F.col("p.evidence").alias("evidence"), F.col("p.confidence").alias("confidence"))
    rows = rows.filter("from_key != to_key and type in ('Calls', 'InvokesEndpoint')")
    for end in ("from_key", "to_key"):
        rows = rows.join(entities.select(*SNAP, F.col("key").alias(end)).distinct(), [*SNAP, end], "left_semi")
    rows = rows.join(rels.select(*SNAP, "from_key", "to_key", "type"), [*SNAP, "from_key", "to_key", "type"], "left_anti")
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)))))
    best = rows.groupBy(*SNAP, "from_key", "to_key", "type").agg(F.max(F.struct("confidence", "evidence")).alias("b"))
    return best.select(*SNAP, "from_key", "to_key", "type", "b.confidence", "b.evidence", F.lit(False).alias("is_static"))


def link_candidates(entities: DataFrame, most: int = 60) -> DataFrame:
    """L14. In snapshots of two languages or more: the longest endpoint-like and the longest other entities."""
    from lattice.functions.scalars import is_endpointish

    mixed = entities.groupBy(*SNAP).agg(F.count_distinct("language").alias("n")).filter("n > 1").select(*SNAP)
    rows = entities.join(mixed, SNAP, "left_semi").withColumn("endpointish", is_endpointish(F.col("symbol"), F.col("path")))
    w = Window.partitionBy(*SNAP, "endpointish").orderBy((F.col("end_line") - F.col("start_line")).desc(), "key")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
