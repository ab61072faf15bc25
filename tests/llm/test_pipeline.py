import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from lattice.llm import bpe, language
from lattice.llm.common import written
from lattice.llm.queries import RANKS
from tests.llm.test_setsketch import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    odd = [(-1, None), (-2, ""), (-3, "12 34 !"), (-4, "one lone word"), (-5, "one lone word"), (-6, "это совсем другой язык и другая азбука")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in odd], docs.schema)
    rows = written(docs.unionByName(extra), "in")
    texts = {r.doc_id: r.text for r in rows.collect()}
    learned = docs
    done = {}
    for name, stage in P.STAGES:
        rows = done[name] = written(stage(spark, rows, SF), name)
    assert done["language_id"].columns == done["near_dedup"].columns == done["mixing"].columns == docs.columns

    prototypes = language.train(learned.unionByName(extra).filter(~language.held_out()))
    names = sorted(prototypes)
    like = (language.profiles([texts[i] for i in sorted(texts)]) @ np.array([prototypes[k] for k in names]).T).max(axis=1)
    count = {i: sum(c.isalpha() for c in t or "") for i, t in texts.items()}
    known = {i for i, score in zip(sorted(texts), like) if count[i] and (score >= language.LEAST_SCORE or count[i] < language.LEAST_LETTERS)}
    assert -6 not in known and {-4, -5} <= known  # another alphabet goes, a few words stay
    assert len([i for i in texts if i >= 0]) - len([i for i in known if i >= 0]) < 5
    assert {r.doc_id for r in done["language_id"].select("doc_id").collect()} == known
    groups = brute([(i, texts[i]) for i in sorted(known)])
    kept = {i for i, (_, _, k) in groups.items() if k}
    assert {r.doc_id for r in done["near_dedup"].select("doc_id").collect()} == kept

    mixed = Counter(r.doc_id for r in done["mixing"].select("doc_id").collect())
    assert set(mixed) <= kept and len(mixed) > 0.8 * len(kept)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(open(RANKS, "rb").read()), special_tokens={})
    out = done["byte_bpe"].collect()
    assert Counter(r.doc_id for r in out) == mixed
    for r in out:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_tables(spark):
    """Repeated and null ids, clashing column names, an empty table."""
    text = " ".join(f"word{i}" for i in range(40))
    kind = "doc_id long, text string, lang string, source string, n_chars long, times int, copy string, _id int, doc string, text_hash long, score double"
    rows = [(1, text, "en", "s", 1, 7, "a", 1, "d", 5, 0.5), (1, text, "en", "s", 1, 7, "b", 1, "d", 5, 0.5), (1, "quite another text of its own", "en", "s", 1, 7, "c", 1, "d", 5, 0.5), (2, text + " more", "en", "s", 1, 7, "d", 1, "d", 5, 0.5), (None, text, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in P.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert sorted(map(tuple, P.keep_known_languages(spark, docs, SF).collect()), key=str) == sorted(rows, key=str)
    kept = P.keep_one_of_each_group(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, text), (1, "quite another text of its own"), (1, text)]
    assert P.encode_and_decode(spark, docs, SF).count() == 5
