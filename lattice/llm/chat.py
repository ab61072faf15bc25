"""Chat formatting over a prefix tree.

The template marks a turn as <|im_start|> role <|im_sep|> text <|im_end|>. Inside roles and texts a backslash is doubled
and a control string gets a backslash after its first character, so no control string survives inside a text, and taking
out each backslash that escapes restores it.

Conversations that share their first turns share nodes of a prefix tree: a node is a prefix of turns, named by a 128-bit
hash. Sorted by their node names, conversations come in depth-first order, and each one adds a run: the nodes that no
earlier one had. A run's text is emitted once. It carries its place in the packed stream, the position id of its first
character (its ancestors' length, as if the conversation stood alone), and its attention: the pieces (run, characters) of
its ancestors that it may see, besides itself causally. Positions count code points. The loss mask lists the spans of
assistant texts.

Nothing is enumerated per pair of conversations; a conversation of n turns costs n rows and one array of n names. The
stream offsets are a prefix scan: within sorted partitions, then over their totals.

Defined cases: a null text or role is empty; rows of a conversation sort by turn (null first), then role and text, and
repeated rows are repeated turns; rows without conv_id form one conversation; identical conversations share one run. An
empty table gives empty results. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.llm.common import written

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that other templates use as control strings; they are escaped as well.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = r"([<\[])(?=\|im_(?:start|sep|end)\|>|/?s>|/?INST\])"
_TURN = r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit(SEP), escape(text), F.lit(END))


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(runs, conversations).

    runs: run, packed_start, position_start, n_chars, text, loss array<struct<start, length>> (in the run's text),
    ancestors array<struct<run, chars>> in order, the first `chars` characters of each run being visible.
    conversations: conv_id, run.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("seg", format_turn(F.col("role"), F.col("body")))
    rows = rows.select(
        "conv", "pos", "seg", F.length("seg").cast("long").alias("chars"), (F.col("role") == ASSISTANT).alias("counts"),
        F.length(F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))).cast("long").alias("head"),
        F.bit_xor(F.xxhash64("pos", "role", "body")).over(so_far).alias("h1"), F.bit_xor(F.xxhash64("body", F.lit(17), "role", "pos")).over(so_far).alias("h2"),
    )
    rows = written(rows, "turns")

    name = F.struct("h1", "h2")
    leaves = rows.groupBy("conv").agg(F.max(F.struct("pos", name.alias("leaf"))).alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("pos", name.alias("node"), "chars"))), lambda x: F.struct(x["node"].alias("node"), x["chars"].alias("chars"))).alias("path"))
    leaves = leaves.select("conv", "last.leaf", "path")
    paths = leaves.groupBy("leaf").agg(F.first("path").alias("path"), F.min("conv").alias("model"))
    # ids that grow in the order of the paths: conversations in depth-first order of the tree
    ranked = written(paths.orderBy("path").withColumn("run", F.monotonically_increasing_id()), "paths")

    nodes = ranked.select("run", F.posexplode("path").alias("pos", "node")).select("run", (F.col("pos") + 1).alias("pos"), F.col("node.node").alias("node"), F.col("node.chars").alias("chars"))
    # written, so that Spark can split the join where very many conversations share a node
    owner = written(nodes.groupBy("node").agg(F.min("run").alias("owner")), "owners")
    pieces = nodes.join(owner, "node").groupBy("run", "owner").agg(F.sum("chars").alias("chars"), F.min("pos").alias("first"))
    runs = written(
        pieces.groupBy("run").agg(
            F.max(F.when(F.col("owner") == F.col("run"), F.col("first"))).alias("first"),
            F.max(F.when(F.col("owner") == F.col("run"), F.col("chars"))).alias("n_chars"),
            F.coalesce(F.sum(F.when(F.col("owner") != F.col("run"), F.col("chars"))), F.lit(0)).alias("position_start"),
            F.array_sort(F.collect_list(F.when(F.col("owner") != F.col("run"), F.struct(F.col("owner").alias("run"), F.col("chars").cast("long").alias("chars"))))).alias("ancestors"),
        ),
        "runs",
    )
    # prefix scan: the high bits of a run id are its sorted partition
    part = F.shiftright("run", 33)
    totals = runs.groupBy(part.alias("part")).agg(F.sum("n_chars").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = runs.withColumn("part", part).join(before, "part")
    placed = placed.withColumn("packed_start", F.col("before") + F.sum("n_chars").over(within) - F.col("n_chars"))

    own = _own_turns(rows, ranked, runs)
    text = own.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("pos", "seg", "start", "counts", "head", "chars"))).alias("t"))
    tail = len(END)
    text = text.select(
        "run", F.array_join(F.transform("t", lambda x: x["seg"]), "").alias("text"),
        F.transform(F.filter("t", lambda x: x["counts"]), lambda x: F.struct((x["start"] + x["head"]).alias("start"), (x["chars"] - x["head"] - tail).alias("length"))).alias("loss"),
    )
    out = written(placed.join(text, "run").select("run", "packed_start", "position_start", "n_chars", "text", "loss", "ancestors"), "tree")
    return out, leaves.join(ranked.select("leaf", "run"), "leaf").select(F.col("conv").alias(conv_col), "run")


def _own_turns(rows: DataFrame, ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """The turns that each run emits, from one conversation that holds them; start is the place in the run's text."""
    wanted = ranked.select("run", "model").join(runs.select("run", "first"), "run")
    own = rows.join(wanted, rows["conv"].eqNullSafe(wanted["model"])).filter("pos >= first")
    so_far = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return own.withColumn("start", F.sum("chars").over(so_far) - F.col("chars"))


def read_back(runs: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, formatted, loss array<string>): each conversation put together from the runs it may see."""
    whole = F.concat("ancestors", F.array(F.struct("run", F.col("n_chars").cast("long").alias("chars"))))
    wants = runs.select(F.col("run").alias("leaf"), F.posexplode(whole).alias("i", "piece")).select("leaf", "i", "piece.run", "piece.chars")
    seen = wants.join(runs.select("run", "text", "loss"), "run")
    spans = F.filter("loss", lambda x: x["start"] + x["length"] <= F.col("chars"))
    seen = seen.select("leaf", "i", F.expr("substring(text, 1, cast(chars as int))").alias("text"), F.transform(spans, lambda x: F.substring("text", (x["start"] + 1).cast("int"), x["length"].cast("int"))).alias("loss"))
    joined = seen.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("i", "text", "loss"))).alias("p"))
    joined = joined.select(F.col("leaf").alias("run"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"), F.flatten(F.transform("p", lambda x: x["loss"])).alias("loss"))
    return conversations.join(joined, "run").select(conv_col, "formatted", "loss")


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read from a formatted conversation."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
