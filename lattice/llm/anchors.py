"""Personal data, found by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, plus signs, digits, `://` and words that announce
an identifier. A parser for each kind of anchor then expands it to the left and right as far as the kind's characters go,
and checks what it got. A parser looks only at the characters of its own span, goes on where the last span of its kind
ended, and does not try again, so a text costs time in proportion to its length.

Kinds, as half-open spans of code points. Those of BASE are exactly the leftmost matches that do not overlap, per kind, of

- email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`,
- ip `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts of 255 at most,
- card `[0-9]([\\x20-]?[0-9])+` with 16 to 19 digits that pass Luhn's test,
- phone `\\+[0-9][\\x20().0-9-]+[0-9]` with 8 to 15 digits,

less those that fail their test. The method adds spans that no such pattern bounds:

- account: after a word of CUES, which stands alone, and a few marks or a word for number: an international bank account
  number whose check digits fit, or 6 to 20 digits with single spaces or hyphens between them;
- address: at an at-sign without an email, a quoted name or letters of any script before it and a host of at least two
  labels of letters of any script after it;
- login: scheme, user information and host of a URL with user information.

Defined cases: null and empty texts have no span; spans of different kinds may overlap; repeated rows get equal results;
whole texts count, however long; an empty table gives an empty one; other columns stay, and one named spans is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "login")
#: Words that announce an account; each is also looked for in capitals and with one capital.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn")
SPAN = "kind string, start int, end int"
#: Texts whose spans leave a task together, in code points.
GROUP = 1 << 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIAL = re.compile(r"\+[0-9][ ().0-9-]++")
_NUMBER = re.compile(r"[\s:#.=-]{0,4}(?:(?i:no|nr|num|number|nummer)\b[\s:#.=-]{0,4})?(?:(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})|(?P<digits>[0-9](?:[ -]?[0-9])++))(?!\w)")
_WIDE_HOST = re.compile(r"@(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)++[^\W\d_]{2,63}(?![\w@])")
_QUOTED = re.compile(r'"[^"@\n]{1,62}"$')
_WIDE = re.compile(r"[^\s@<>()\[\],;:\"\\]{1,65}$")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{0,31}$")
_USER = re.compile(r"://[^\s/@?#]++@[^\s/@?#]++")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(text: str) -> int:
    """Length of the longest part of text, cut at a space or its end, whose check digits fit; 0 if none does."""
    for end in sorted({len(text), *(m.start() for m in re.finditer(" ", text))}, reverse=True):
        iban = text[:end].replace(" ", "")
        if 15 <= len(iban) <= 34 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1:
            return end
    return 0


@cache
def _automaton(cues: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for key in ("@", "+", "://", *"0123456789"):
        out.add_word(key, (key if not key.isdigit() else "digit", len(key)))
    for cue in cues:
        for form in (cue.lower(), cue.upper(), cue.capitalize()):
            out.add_word(form, ("cue", len(cue)))
    out.make_automaton()
    return out


def spans_of(text: str, cues: tuple[str, ...] = CUES) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail = dotted = chain = 0  # where the next span of a kind may begin
    for last, (what, size) in _automaton(cues).iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                if dotted - at > 6:
                    parts, s = m[0].split("."), at
                    ends = []
                    for p in parts:
                        ends.append((s, s + len(p), p))
                        s += len(p) + 1
                    for i in range(0, len(ends) - 3, 4):
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for *_, p in ends[i : i + 4]):
                            found["ip"].append((ends[i][0], ends[i + 3][1]))
            if at >= chain:
                m = _CHAIN.match(text, at)
                chain = m.end() if m else at + 1
                if chain - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, chain))
        elif what == "@":
            m, s = _HOST.match(text, at), at
            if m:
                while s > mail and text[s - 1] in _LOCAL:
                    s -= 1
            if m and s < at:
                mail = m.end()
                found["email"].append((s, mail))
            elif m := _WIDE_HOST.match(text, at):
                before = text[max(0, at - 65) : at]
                name = _QUOTED.search(before) or _WIDE.search(before)
                if name and len(name[0]) <= 64:  # a longer one cannot be a mailbox
                    found["address"].append((at - len(name[0]), m.end()))
        elif what == "+":
            if m := _DIAL.match(text, at):
                end = m.end()
                while text[end - 1] not in "0123456789":
                    end -= 1
                if end - at >= 4 and 8 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                    found["phone"].append((at, end))
        elif what == "://":
            scheme, m = _SCHEME.search(text[max(0, at - 32) : at]), _USER.match(text, at)
            if scheme and m:
                found["login"].append((at - len(scheme[0]), m.end()))
        elif not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
            m = _NUMBER.match(text, last + 1)
            if m and m["digits"] is not None and 6 <= sum(c.isdigit() for c in m["digits"]) <= 20:
                found["account"].append(m.span("digits"))
            elif m and m["iban"] is not None and (size := _iban(m["iban"])):
                found["account"].append((m.start("iban"), m.start("iban") + size))
    return [(k, s, e) for k in KINDS for s, e in sorted(set(found[k]))]


def find(df: DataFrame, text_col: str = "text", cues: tuple[str, ...] = CUES) -> DataFrame:
    """df with spans, an array of (kind, start, end) by kind as listed, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at, held, size = 0, [], 0
            for i, text in enumerate(whole.column(1)):
                text = text.as_py() or ""
                held.append(spans_of(text, cues))
                size += len(text)
                if size >= GROUP or i == whole.num_rows - 1:
                    flat = [x for spans in held for x in spans]
                    offsets = [0]
                    for spans in held:
                        offsets.append(offsets[-1] + len(spans))
                    items = pa.StructArray.from_arrays([pa.array([x[j] for x in flat], pa.int32() if j else pa.string()) for j in range(3)], ["kind", "start", "end"])
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, len(held)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], ["kept", "spans"])
                    at, held, size = at + len(held), [], 0

    stay = [c for c in df.columns if c.lower() != "spans"]
    rows = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in stay)).alias("kept"), F.col(text_col).cast("string").alias("text"))
    kind = T.StructType([rows.schema["kept"], *T._parse_datatype_string(f"spans array<struct<{SPAN}>>").fields])
    out = rows.mapInArrow(run, kind)
    return out.select(*(F.col("kept").getField(c).alias(c) for c in stay), "spans")


def masked(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """df with each span of text_col replaced by its kind in angle brackets; of overlapping spans the first in the text,
    then the longest, counts."""
    order = F.array_sort(spans_col, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(acc, s):
        keep = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], keep, F.lit("<"), s["kind"], F.lit(">")).alias("out")))

    done = F.aggregate(order, empty, step)
    return df.withColumn(text_col, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
