import numpy as np

from lattice.llm import language as L
from lattice.llm.queries import op7_language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op7_language(spark, sf).collect()]
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out]
    assert 150 < len(out) < 350
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    train = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de"), (3, "nothing", None), (None, "x y z", "zz"), (4, None, "en")], "doc_id long, text string, lang string")
    protos = L.train(train)
    assert sorted(protos) == ["de", "en"]
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 34!", 1), (4, "the hat", 1), (4, "the hat", 1), (5, "der " * 400_000, 1), (None, "und die", 1)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(df, protos).collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (None, "de")]
    assert got[3] == got[4] and got[0][2] == 0
    assert L.predict(df.limit(0), protos).count() == 0
    assert {r.lang_pred for r in L.predict(df, L.train(train.limit(0))).collect()} == {"und"}


def test_pieces_of_a_long_text_make_the_same_profile(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog, " * 50
    whole = L.profiles([text])
    for piece in (1, 7, 500, len(text) - 1):
        monkeypatch.setattr(L, "PIECE", piece)
        assert abs((L.profiles([text]) @ whole[0]).item() - 1) < 1e-9


def brute_profile(text):
    low = [c.lower() if len(c.lower()) == 1 else c for c in text or ""]
    at = lambda i: ord(low[i]) if 0 <= i < len(low) and low[i].isalpha() else 0
    out = np.zeros(L.DIM)
    for i in range(len(low)):
        if at(i):
            one, two, three = (L._vectors(np.array([at(j)]))[0].astype(float) for j in (i - 1, i, i + 1))
            out += np.roll(one, 2) * np.roll(two, 1) * three
    n = np.sqrt(out @ out)
    return out / n if n else out


def test_equals_a_plain_bundle(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "der Hund, die Katze", "de"), (3, "le chat et l'oiseau", "fr"), (4, "\u0130stanbul ve deniz", "tr"), (5, "", "en"), (6, None, "de"), (7, "a", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for _, text, lang in rows:
        sums[lang] = sums.get(lang, 0) + brute_profile(text)
    protos = {k: v / np.sqrt(v @ v) for k, v in sorted(sums.items())}
    got = L.train(df.repartition(16))  # more tasks than rows: some have none
    assert list(got) == list(protos)
    assert all(np.allclose(got[k], protos[k], atol=1e-6) for k in protos)
    for r in L.predict(df, got).collect():
        cosine = {k: brute_profile(dict((i, t) for i, t, _ in rows)[r.doc_id]) @ v for k, v in protos.items()}
        if r.doc_id in (5, 6):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == max(cosine, key=cosine.get) and abs(r.score - max(cosine.values())) < 1e-6


def test_kept_columns_of_any_name(spark):
    protos = L.train(spark.createDataFrame([(1, "the cat", "en")], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the cat", "x", 2.0, [1], "y"), (2, "12", None, None, None, None)], "doc_id long, text string, lang_pred string, score double, _text array<int>, kept string")
    out = L.known(df, protos)
    assert out.schema == df.schema and out.collect() == [df.first()]
    assert L.predict(df, protos, keep=tuple(df.columns)).columns == ["doc_id", "text", "_text", "kept", "lang_pred", "score"]


def test_known_follows_the_prototypes(spark):
    text = {"en": "the cat sat on the mat and looked at the other cats in the house", "ru": "кошка сидела на коврике и смотрела на других кошек в доме"}
    df = spark.createDataFrame([(1, text["en"]), (2, text["ru"]), (3, "кот"), (4, None), (5, "the cats sat in the house and looked on")], "doc_id long, text string")
    protos = {k: L.train(spark.createDataFrame([(1, t, k)], "doc_id long, text string, lang string")) for k, t in text.items()}
    ids = lambda p, **k: [r.doc_id for r in L.known(df, p, **k).collect()]
    assert ids(protos["en"]) == [1, 3, 5] and ids(protos["ru"]) == [2, 3] and ids(protos["en"] | protos["ru"]) == [1, 2, 3, 5]
    assert ids(protos["en"], letters=1) == [1, 5] and ids({}) == []
