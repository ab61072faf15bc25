"""One query for each operator, over its whole table, and the SQL that DuckDB can run for it."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import anchors, bpe, chat, html, language, mixing, periods, setsketch, spotsigs, tokencount, trie, urls, vectors
from lattice.llm.common import read, shared_dir

#: Folder of the tokenizer files, and the rank file in it.
RANKS = os.environ.get("LATTICE_RANKS") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read(spark, sf_dir, "documents"))


#: Pairs by their shingles, without sketches; components by the least id reached.
OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.to_id) AS component_id, d.doc_id = min(r.to_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id
GROUP BY d.doc_id, n.n
"""


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r(id, to_id) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, min(r.to_id) AS component_id, e.vec_id = min(r.to_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN r ON r.id = e.vec_id
GROUP BY e.vec_id, n.n
"""

def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    prototypes = language.train(docs.filter(~language.held_out()))
    out = language.predict(docs, prototypes)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return urls.judge(read(spark, sf_dir, "pages"), rules)


#: The rules, and aliases by absolute canonical links.
OP4 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '#.*', '') AS key,
    regexp_replace(regexp_replace(regexp_extract(regexp_extract(html, '<link[^>]*canonical[^>]*>'), 'href="([^"]*)"', 1), '^[a-z]*://', ''), '#.*', '') AS target
  FROM p),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM h),
e AS (SELECT key AS a, target AS b FROM r WHERE target <> '' UNION SELECT target, key FROM r WHERE target <> ''),
reach(k, t) AS (SELECT a, a FROM e UNION SELECT reach.k, e.b FROM reach JOIN e ON e.a = reach.t),
bad AS (SELECT DISTINCT reach.k FROM reach JOIN r ON r.key = reach.t WHERE r.rule IN ('net/', 'example.com/de/'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad.k IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN bad ON bad.k = r.key
"""

def spot_digest(docs: DataFrame) -> DataFrame:
    text, edit = F.col("text"), F.col("edited")
    rows = spotsigs.with_next(docs).withColumn("edited", spotsigs.edited(text, F.col("next_text")))
    rows = rows.select(
        F.col("id").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.sha2(edit, 256).alias("edited_sha256"),
        spotsigs.signatures(text).alias("own"), spotsigs.signatures(edit).alias("other"), spotsigs.signatures(F.col("next_text")).alias("next"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spotsigs.fingerprint(F.col("own")).alias("fingerprint"), spotsigs.fingerprint(F.col("other")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("own"), F.col("other")).alias("near_edited"), spotsigs.likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_digest(read(spark, sf_dir, "documents"))


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints compared through length partitions and pruned Jaccard: components of documents."""
    return spotsigs.near_duplicates(read(spark, sf_dir, "documents"))


def chat_digest(turns: DataFrame) -> DataFrame:
    runs, conversations = chat.prefix_tree(turns)
    back = chat.read_back(runs, conversations).withColumn("turns", chat.turns_of(F.col("formatted")))
    back = back.withColumn("said", F.array_join(F.transform("loss", chat.unescape), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    return chat_digest(turns.unionByName(more))


OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + 32
    + (length(role) - length(replace(role, chr(92), ''))) + (length(text) - length(replace(text, chr(92), '')))
    + len(regexp_extract_all(role, '<\|im_(?:start|sep|end)\|>|</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '<\|im_(?:start|sep|end)\|>|</?s>|\[/?INST\]')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Target share of each domain of the label table in the mix.
SHARES = {"high": 0.82, "low": 0.15, "toxic": 0.03}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.mix(read(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), SHARES)
    return rates.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(SHARES)), "rate")


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files are made from the whole table, then counted without looking at it again."""
    path = f"{shared_dir(spark)}/lattice/tokens-{uuid.uuid4().hex}"
    tokencount.write_texts(read(spark, sf_dir, "documents"), path, RANKS, public_tokenizers.PATTERN)
    return tokencount.count_tokens(spark, path)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, pos, role, text): each conversation c with its first h = crc32(c) % 4 turns taken from conversation c - c % 20.
    A row without a pos names each conversation."""
    own = trie.placed(turns)
    h = F.crc32(F.col("conv").cast("string")) % 4
    convs = own.select("conv").distinct()
    heads = own.filter("conv % 20 = 0 and pos <= 3").withColumnRenamed("conv", "base")
    begun = convs.withColumns({"base": F.col("conv") - F.col("conv") % 20, "h": h}).join(heads, "base").filter("pos <= h").select("conv", "pos", "role", "text")
    named = convs.select("conv", F.lit(None).cast("int").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    return begun.unionByName(own.filter(F.col("pos") > h)).unionByName(named)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt(read(spark, sf_dir, "conversations")))


#: Prefixes as lists; the checksum bit by bit.
OP11 = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce([4294967295] || list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(c AS VARCHAR), i, 1))),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT CAST(c AS BIGINT) AS c FROM t)),
r AS (
  SELECT k.c, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.pos <= k.h
  UNION ALL SELECT k.c, t.pos, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS d, sha256(concat(length(role), ':', role, text)) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
p AS (SELECT c, d, w, sha256(string_agg(key, '' ) OVER (PARTITION BY c ORDER BY d)) AS p FROM n UNION ALL SELECT c, 0, 0, 'root' FROM k),
g AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved FROM p GROUP BY p, d),
u AS (SELECT DISTINCT a.p AS p, b.p AS parent FROM p a JOIN p b ON a.c = b.c AND b.d = a.d - 1),
kids AS (SELECT parent AS p, count(*) AS n FROM u GROUP BY 1),
s AS (SELECT DISTINCT a.p AS p, b.p AS below FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT s.p, sum(g.saved) AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves FROM s JOIN g ON g.p = s.below LEFT JOIN kids ON kids.p = s.below GROUP BY s.p),
e AS (SELECT p.p, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS h FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) m ON m.c = p.c AND m.d = p.d GROUP BY p.p)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves,
  CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM g JOIN sums ON sums.p = g.p LEFT JOIN kids ON kids.p = g.p LEFT JOIN u ON u.p = g.p LEFT JOIN g q ON q.p = u.parent LEFT JOIN e ON e.p = g.p
"""


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) % 10 is 0, each word i >= a is word a + (i - a) % p of the text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    docs = docs.select("doc_id", text.alias("text"), h.alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, _words(F.col("text"))))
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.expr("1 + (size(w) - a) div (3 + h div 10 % 8)"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    edited = F.array_join(F.transform(places, lambda j: F.get(F.col("w"), j.cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("p").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_digest(with_periods(read(spark, sf_dir, "documents")))


def period_digest(docs: DataFrame) -> DataFrame:
    best = periods.strongest(F.col("runs"))
    out = periods.periodic_runs(docs).withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read(spark, sf_dir, "documents"))


def pii_digest(docs: DataFrame) -> DataFrame:
    found = anchors.find(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*anchors.BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in anchors.BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_mixing": op1_mixing, "op2_byte_bpe": op2_byte_bpe, "op3_spotsigs": op3_spotsigs, "op4_urls": op4_urls, "op5_setsketch": op5_setsketch,
    "op6_chat_tree": op6_chat_tree, "op7_language": op7_language, "op8_vectors": op8_vectors, "op9_separator_scan": op9_separator_scan, "op10_html": op10_html,
    "op11_prefix_trie": op11_prefix_trie, "op12_periodic_runs": op12_periodic_runs, "op13_personal_data": op13_personal_data,
    "spotsigs_near_duplicates": spotsigs_near_duplicates,
}
ORACLES: dict[str, str] = {"op4_urls": OP4, "op5_setsketch": OP5, "op6_chat_tree": OP6, "op8_vectors": OP8, "op11_prefix_trie": OP11}
