import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lattice.llm import bpe
from lattice.llm.queries import RANKS

DATA = open(RANKS, "rb").read()


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.parse_ranks(DATA)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_match_the_library(pair):
    own, theirs = pair
    rnd = random.Random(1)
    alphabets = ["abcdefghij ", "éèß ñ\n\t '", "0123456789,.!?", "日本語中文字", "\U0001f600\U0001f468‍", "aaab"]
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randint(0, 60)))
        assert own.encode(text) == theirs.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()


def test_every_code_point_splits_as_in_the_library(pair):
    own, theirs = pair
    for start in range(0, 0x30000, 512):
        text = "".join("a" + chr(c) + " " + chr(c) + "1" for c in range(start, start + 512) if not 0xD800 <= c < 0xE000)
        if own.encode(text) != theirs.encode_ordinary(text):
            bad = [hex(ord(x)) for x in text if own.encode("a" + x + " " + x + "1") != theirs.encode_ordinary("a" + x + " " + x + "1")]
            raise AssertionError(sorted(set(bad))[:50])


def test_compatibility_is_what_merging_gives(pair):
    own, rnd = pair[0], random.Random(2)
    tokens = [r for r in own.length if len(own.bytes_of[r]) <= 8]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(20_000)]
    pairs += [(own.ranks[t[:k]], own.ranks[t[k:]]) for t in list(own.ranks)[300:8_000] for k in range(1, len(t)) if own.ranks.get(t[:k]) in own.length and own.ranks.get(t[k:]) in own.length]
    for a, b in pairs:
        assert own._fits(a, b) == (bpe.merge(own.bytes_of[a] + own.bytes_of[b], own.ranks) == [a, b])


def test_long_pieces_are_linear(pair):
    own, theirs = pair
    for text in ("a" * 20_000, "ab" * 10_000, " " * 5_000 + "x", "é" * 5_000):
        assert own.encode(text) == theirs.encode_ordinary(text)


def test_rows(spark, pair):
    texts = [(1, None, 7), (2, "", 7), (3, "Ein Text, zwei  Texte", 7), (3, "Ein Text, zwei  Texte", 7), (None, "x" * 3000, 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, keep=("ids",))
    got = sorted((r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted((i or 0, pair[1].encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in texts)
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query_matches_the_library(spark, pair):
    from lattice.llm.queries import op2_byte_bpe

    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = pair[1].encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_byte_bpe(spark, sf).collect()} == want
