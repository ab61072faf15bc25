import hashlib
import random
import re
import time

from lattice.llm import anchors as A
from lattice.llm.queries import op13_personal_data, pii_digest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def base(text):
    return [s for s in A.spans_of(text) if s[0] in A.BASE]


def test_base_spans_are_the_patterns_matches():
    rnd = random.Random(3)
    parts = ["1", "2", "5", "0", "9", ".", "@", "+", "-", " ", "(", ")", "a", "B", "_", "%", "é", "٣", "\n", "192.168.0.1", "4111 1111 1111 1111", "4111111111111111", "+49 170 1234567", "x@y.z", "://", "iban "]
    for _ in range(40_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))
        assert base(text) == brute(text), text


def test_added_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00 AND account no. 12345678, jürgen@exämple.de \"john doe\"@bücher.example ftp://bob:pw@host/x ssn 123-45-6789"
    got = [(k, text[s:e]) for k, s, e in A.spans_of(text) if k not in A.BASE]
    assert got == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678"), ("account", "123-45-6789"), ("address", "jürgen@exämple.de"), ("address", '"john doe"@bücher.example'), ("login", "ftp://bob:pw@host")]
    for clean in ("IBAN DE89 3704 0044 0532 0130 01", "accounting 12345678", "my account 123", "see https://example.com/a@b", "a @ b", "x@y", "@name said", "discount 12345678", "user@.de", "a" * 70 + "é@éx.de"):
        assert A.spans_of(clean) == [], clean


def test_long_texts_take_no_square():
    shapes = (("a", "@"), ("@", ""), ("1", ""), ("1.", ""), ("+", ""), ("+1(", ""), ("://", ""), ("iban ", ""), ("a@b", ""), ("iban DE12 ", ""), ("1 ", ""))
    for part, end in shapes:
        assert base(part * 300 + end) == brute(part * 300 + end)
    began = time.process_time()
    found = {part: len(base(part * 200_000 + end)) for part, end in shapes}
    assert found.pop("1.") == 50_000 and not any(found.values())
    assert time.process_time() - began < 30


def expected(doc_id, text):
    spans = brute(text)
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (doc_id, *(sum(s[0] == k for s in spans) for k in A.BASE), hashlib.sha256(said.encode()).hexdigest())


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\U0001f600 a@b.c"), (3, "\U0001f600 a@b.c"), (4, "x " * 500_000 + "a@b.cd +1 (234) 567-8901"), (5, "4111-1111-1111-1111 10.0.0.256 10.0.0.255")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, spans string, kept int")
    assert rows_of(pii_digest(df)) == sorted(expected(*r) for r in rows)
    assert A.find(df).columns == ["doc_id", "text", "kept", "spans"]
    assert pii_digest(df.limit(0)).collect() == []


def test_masked(spark):
    df = spark.createDataFrame([("to a@b.cd, +1 (234) 567-8901!",), ("ftp://u:p@q.rs x",), (None,), ("none",)], "text string")
    assert [r.text for r in A.masked(A.find(df)).collect()] == ["to <email>, <phone>!", "<login> x", None, "none"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = op13_personal_data(spark, sf)
    assert rows_of(out) == sorted(expected(r.doc_id, r.text) for r in docs)
    texts = {r.doc_id: r.text for r in docs}
    for r in out.collect():
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in A.spans_of(texts[r.doc_id] or ""))
