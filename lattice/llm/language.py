"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a letter n-gram binds the vectors of its letters, each permuted by its
place, by elementwise product; a document bundles (adds up) the vectors of its n-grams. A language's prototype is the sum
of the unit vectors of its training documents. The prediction is the prototype of greatest cosine, the score that cosine
(0 at least).

Training takes at most about TRAIN documents of each language, drawn by a hash of the id, so its cost is bounded; only a
DIM-vector per language reaches the driver. More than MAX_LANGUAGES languages (a parameter) are refused, not cut, so what
is sent to the tasks is bounded too.

Defined cases: null text, or text without a letter, is `und` with score 0, as is everything if nothing can be learned;
rows without a language or an id are not learned from; whole texts count, in pieces of bounded size; repeated rows get
equal results; tasks may be empty; ties go to the first language by name. Only the named columns are read;
columns that are kept pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM, GRAM, TRAIN, MAX_LANGUAGES = 512, 3, 20_000, 1_000
UNKNOWN = "und"
#: known() rejects a text of LEAST_LETTERS letters or more whose cosine to every prototype is below LEAST_SCORE. Vectors
#: of DIM that have nothing in common reach 0.13 in one of a thousand pairs; shorter texts say too little to be judged.
LEAST_SCORE, LEAST_LETTERS = 0.1, 20
#: Characters, and texts, whose n-grams are counted at once; rows that are handled at once.
PIECE, GROUP, ROWS = 100_000, 100, 500


@cache
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for anything else."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_VECTORS: dict[int, np.ndarray] = {}


def _vectors(points: np.ndarray) -> np.ndarray:
    if len(_VECTORS) > 50_000:
        _VECTORS.clear()
    for p in points:
        if p not in _VECTORS:
            # the word boundary (0) binds as the identity
            _VECTORS[p] = np.random.default_rng(int(p)).choice(np.array([-1, 1], np.int8), DIM) if p else np.ones(DIM, np.int8)
    return np.stack([_VECTORS[p] for p in points])


def _gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vector of each packed n-gram."""
    out = None
    for place in range(GRAM):
        points, index = np.unique((grams >> (21 * (GRAM - 1 - place))) & 0x1FFFFF, return_inverse=True)
        part = np.roll(_vectors(points), GRAM - 1 - place, axis=1)[index]
        out = part if out is None else out * part
    return out.astype(np.float32)


def _bundle(x: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
    """Add n-grams to the rows of out. x: letters, with one more before and one more after those that count; doc: the row
    of each that counts. What stands next to a letter and is none is a word boundary."""
    middle = x[1:-1] != 0
    grams = ((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])[middle]
    if not len(grams):
        return
    known, index = np.unique(grams, return_inverse=True)
    counts = np.bincount(doc[middle] * len(known) + index, minlength=len(out) * len(known)).reshape(len(out), -1).astype(np.float32)
    for s in range(0, len(known), 4096):
        out += counts[:, s : s + 4096] @ _gram_vectors(known[s : s + 4096])


def _points(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def profiles(texts: list[str | None]) -> np.ndarray:
    """Unit vector of each text; zero where there is no letter. A text longer than PIECE goes piece by piece, each with
    the letter before and after it, so its profile is that of the whole text."""
    out, start, size = np.zeros((len(texts), DIM), np.float64), 0, 0
    for i in range(len(texts) + 1):
        n = len(texts[i] or "") if i < len(texts) else 0
        if i > start and (i == len(texts) or size + n > PIECE or i - start >= GROUP):
            part = [t or "" for t in texts[start:i]]
            if len(part) == 1:
                for s in range(0, len(part[0]), PIECE):
                    piece = part[0][max(0, s - 1) : s + PIECE + 1]
                    x = np.concatenate([[0] * (s == 0), _points(piece), [0] * (s + PIECE >= len(part[0]))]).astype(np.int64)
                    _bundle(x, np.zeros(len(x) - 2, np.int64), out[start:i])
            else:
                doc = np.repeat(np.arange(len(part)), [len(t) + 1 for t in part])
                _bundle(np.concatenate([[0], _points("\n".join(part) + "\n"), [0]]).astype(np.int64), doc, out[start:i])
            start, size = i, 0
        size += n
    norm = np.sqrt((out * out).sum(axis=1))[:, None]
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Unit prototype of each language; refuses more than `most` languages, all of which every task would hold."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, TRAIN / r["count"]) * 1_000_000))))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < F.element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                unit, langs = profiles(part.column(0).to_pylist()), np.array(part.column(1).to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + unit[langs == lang].sum(axis=0)
        if total:  # a task without rows has nothing to say
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    parts = drawn.select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = r["x"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.sqrt(v @ v)) > 0}


def _predicted(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """(kept struct of keep, lang_pred, score); the kept columns pass through as they are."""
    names, matrix = list(prototypes), np.array(list(prototypes.values())).reshape(-1, DIM).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                unit = profiles(part.column(1).to_pylist())
                found = unit.any(axis=1) & bool(names)
                cosine = unit @ matrix if names else np.zeros((len(unit), 1))
                best = cosine.argmax(axis=1)
                score = np.where(found, np.clip(cosine[np.arange(len(unit)), best], 0, 1), 0.0)
                said = pa.array([names[b] if f else UNKNOWN for b, f in zip(best, found)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), said, pa.array(score)], ["kept", "lang_pred", "score"])

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["kept"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep... with lang_pred and score, which replace kept columns of these names; the text is the only input of a
    prediction."""
    stay = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    out = _predicted(df, prototypes, text_col, keep)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in stay), "lang_pred", "score")


def known(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", least: float = LEAST_SCORE, letters: int = LEAST_LETTERS) -> DataFrame:
    """The rows of df, with all their columns as they are, whose text is in some learned language: it has a letter and is
    like a prototype, or too short to tell."""
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)), F.length(F.regexp_replace(F.col(text_col).cast("string"), r"\P{L}+", "")).alias("letters"), F.col(text_col).alias("judged"))
    out = _predicted(rows, prototypes, "judged", tuple(rows.columns[:-1]))
    out = out.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= least) | (F.col("kept.letters") < letters)))
    return out.select(*(F.col("kept").getField(f"c{i}").alias(c) for i, c in enumerate(df.columns)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of ids that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
