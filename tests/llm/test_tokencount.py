import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.errors import PythonException

from lattice.llm import bpe
from lattice.llm import tokencount as K
from lattice.llm.queries import RANKS, op9_separator_scan


def test_blocks_of_any_size_give_the_same_counts(spark, tmp_path):
    rnd = random.Random(1)
    docs = [[rnd.randrange(50_256) for _ in range(rnd.choice([0, 0, 1, 5, 40, 300]))] for _ in range(200)]
    path = f"file://{tmp_path}/t"
    K.write_tokens(spark.createDataFrame([(d,) for d in docs], "ids array<int>").coalesce(3), path, row=400, file=1200)
    assert len(list(tmp_path.glob("t/part-*"))) > 8
    for block in (2, 14, 100, 1 << 20):
        rows = K.count_tokens(spark, path, block).collect()
        assert Counter(r.n_tokens for r in rows) == Counter(map(len, docs))
        by = {}
        for r in rows:
            by.setdefault(r.file, []).append(r.doc)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_open_end_and_no_documents(spark):
    import numpy as np

    data = lambda *ids: bytearray(np.array(ids, ">u2").tobytes())
    blocks = spark.createDataFrame([("a", 0, data(1, 2)), ("a", 1, data(3, K.END)), ("a", 2, data(K.END, 4)), ("a", 3, data(5)), ("b", 0, data(7))], "file string, block int, bytes binary")
    assert sorted(tuple(r) for r in K.stitch(K.scan(blocks)).collect()) == [("a", 0, 3), ("a", 1, 0), ("a", 2, 2), ("b", 0, 1)]
    assert K.stitch(K.scan(blocks.limit(0))).count() == 0


def test_query_counts_what_encoding_gives(spark):
    sf = "/root/testdata/sf0.001"
    e = bpe.Encoder(bpe.parse_ranks(open(RANKS, "rb").read()), public_tokenizers.PATTERN)
    want = Counter(len(e.encode(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert Counter(r.n_tokens for r in op9_separator_scan(spark, sf).collect()) == want


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    for bad in (K.END, 65_536 + 3, -1):
        with pytest.raises(PythonException, match="token ids must be"):
            K.write_tokens(spark.createDataFrame([([1, bad],)], "ids array<int>"), f"file://{tmp_path}/bad{bad}")
    K.write_tokens(spark.createDataFrame([(None,), ([],), ([7],)], "ids array<int>").coalesce(1), f"file://{tmp_path}/odd")
    assert sorted(r.n_tokens for r in K.count_tokens(spark, f"file://{tmp_path}/odd").collect()) == [0, 0, 1]
