"""Classification and text helpers: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERIFIED, ACCEPTED = 0.9, 0.7

#: Fixed vocabularies.
LANGUAGES = {
    "cs": "c_sharp", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "tsx", "py": "python", "go": "go", "php": "php", "rb": "ruby",
}
STORAGE = ("entities", "models", "repository", "repositories", "persistence", "storage")
CONTAINERS = ("src", "app", "lib", "main", "source", "test", "tests", "packages", "services", "api", "web", "infra", "infrastructure")
ROLE_BY_KIND = {"Method": "Member", "Function": "Member", "Property": "Member", "Event": "Member", "Interface": "Contract", "Enum": "Enumeration", "Record": "DataRecord", "Struct": "ValueObject"}
ROLE_BY_SUFFIX = (
    ("Controller", "Controller"), ("Service", "Service"), ("Repository|Repo", "Repository"), ("Endpoint", "Endpoint"), ("Handler", "Handler"),
    ("Provider", "Provider"), ("Publisher", "EventPublisher"), ("EventConsumer|Subscriber", "EventConsumer"),
    ("Configuration|Options|Settings", "Configuration"), ("Dto|Request|Response|ViewModel", "DTO"),
)
REVIEW_LABELS = {"NeedsReview": "needs_review", "Stale": "stale", "Accepted": "accepted", "Edited": "edited"}
EDGE_VERBS = {"Calls": "calls", "HasMethod": "contains", "Inherits": "extends", "Implements": "implements", "FieldDependency": "uses", "Injected": "injects", "InvokesEndpoint": "calls endpoint"}


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return F.coalesce(found, default) if default is not None else found


def file_language(path: Column) -> Column:
    """Language by extension, null where it is not supported."""
    return lookup(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), LANGUAGES)


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def structural_hash(kind: Column, name: Column, bases: Column, callees: Column) -> Column:
    """SHA-256 of kind, name, sorted bases and sorted distinct last segments of the callees, each length-prefixed."""
    last = F.array_sort(F.array_distinct(F.transform(F.coalesce(callees, F.array().cast("array<string>")), lambda c: F.substring_index(c, ".", -1))))
    parts = F.concat(F.array(kind, name), F.array_sort(F.coalesce(bases, F.array().cast("array<string>"))), F.array(F.lit("|")), last)
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p)), ""), 256)


def tier_of(confidence: Column) -> Column:
    return F.when(confidence >= VERIFIED, "verified").when(confidence >= ACCEPTED, "accepted").otherwise("low-confidence")


def classify_node(model: Column, confidence: Column, review: Column) -> dict[str, Column]:
    inferred = (F.coalesce(model, F.lit("")) != "") | (confidence < 1)
    return {
        "evidence": F.when(inferred, "inference").otherwise("fact"),
        "source": F.when(inferred, "Inference").otherwise("AST"),
        "tier": F.when(review == "accepted", "verified").otherwise(tier_of(confidence)),
    }


def classify_edge(is_static: Column, confidence: Column) -> dict[str, Column]:
    fact = is_static & (confidence >= 1)
    return {"evidence_class": F.when(fact, "fact").otherwise("inference"), "tier": tier_of(confidence)}


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    stem = F.regexp_replace(F.regexp_extract(low, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return low.rlike(r"(^|/)tests?(/|$)") | stem.rlike(r"^(test|spec)|(test|tests|spec)$|\.(test|spec)")


def is_storage_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, STORAGE)))


def infer_role(kind: Column, symbol: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, role in ROLE_BY_KIND.items():
        out = out.when(kind == k, role)
    for suffix, role in ROLE_BY_SUFFIX:
        out = out.when(symbol.rlike(f"(?i)({suffix})$"), role)
    return out.when(kind == "Class", "Domain").otherwise("Component")


def infer_context(path: Column) -> Column:
    """First folder that is no mere container, in PascalCase; Root if there is none. The last segment with a dot is the
    file, and what stands before it are folders; without a dot all segments are folders."""
    segments = F.filter(F.transform(F.split(path, r"[/\\]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    dotted = F.filter(F.transform(segments, lambda s, i: F.when(F.contains(s, F.lit(".")), i)), lambda i: i.isNotNull())
    folders = F.when(F.size(dotted) > 0, F.slice(segments, F.lit(1), F.element_at(dotted, -1))).otherwise(segments)
    named = F.filter(folders, lambda s: ~F.lower(s).isin(*CONTAINERS))
    words = F.filter(F.split(F.get(named, F.lit(0)), r"[-_ ]+"), lambda w: w != "")
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""), F.lit("Root"))


def module_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def cluster_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def review_label(status: Column) -> Column:
    return lookup(status, REVIEW_LABELS, F.lit("none"))


def edge_label(kind: Column) -> Column:
    return lookup(kind, EDGE_VERBS, F.lower(kind))


def is_endpointish(symbol: Column, path: Column) -> Column:
    return F.lower(F.concat_ws(" ", symbol, path)).rlike(r"controller|endpoint|handler|route|/api/|http|fetch|axios|client|service")


def estimate_tokens(text: Column) -> Column:
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


#: English and Portuguese words that a question's tokens leave out (fixed values).
STOP_WORDS = (
    "what why how which does this that these those with from into "
    "they them you your are was were has have had will would can "
    "could should where when who whose and but for not one all any "
    "each more most other some such than too very just about also the "
    "que para com por uma como qual quais pode podem ser sao não "
    "estao está esta ainda depois antes sobre entre cada mesmo seu sua"
).split()


def tokenize(text: Column) -> Column:
    """Distinct lower-cased words of three characters or more, without stop words, in order of first sight."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n == 0) | (norm == 0), F.lit(0.0)).otherwise(dot(x, y) / norm)


def mermaid_label(text: Column) -> Column:
    short = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("…"))).otherwise(text)
    return F.replace(short, F.lit('"'), F.lit("#quot;"))


def mermaid_id(text: Column) -> Column:
    found = F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""), 1, 40)
    return F.when(found == "", "entity").otherwise(found)


def summary_tier(start: Column, end: Column, limit: int = 200) -> Column:
    return F.when(end - start >= limit, "large").otherwise("primary")
