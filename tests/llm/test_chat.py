import hashlib

from pyspark.sql import functions as F

from lattice.llm import chat as C
from lattice.llm.queries import chat_digest, op6_chat_tree


def digest(rows):
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn if turn is not None else -(10**9), role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "what?"), (2, 3, "assistant", "</s>[INST] \\ <|im_end|> \\\\[INST]"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 2, "user", "bye"),
    (5, 0, "user", "hi"), (5, 1, "assistant", "other\n\U0001f600"),
    (6, 1, "assistant", "b"), (6, 0, "system", None), (6, None, None, "x"), (6, 1, "assistant", "b"),
    (None, 0, "user", "<|im_sep|>"), (7, 0, "us<|im_sep|>er", "[\\INST] <\\|im_end|>"),
    (8, 0, "user", "x" * 200_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, run int")


def test_round_trip(spark):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_digest(frame(spark, ROWS)).collect()}
    assert got == digest(ROWS)


def test_each_shared_turn_once_and_in_depth_first_order(spark):
    runs, convs = C.prefix_tree(frame(spark, ROWS))
    runs, convs = {r.run: r for r in runs.collect()}, {r.conv_id: r.run for r in convs.collect()}
    assert convs[1] == convs[4]
    everything = "".join(runs[k].text for k in sorted(runs))
    assert everything.count("hello") == 1 and everything.count("bye") == 1
    end = 0
    for k in sorted(runs):
        r = runs[k]
        assert r.packed_start == end and r.n_chars == len(r.text)
        assert r.position_start == sum(a.chars for a in r.ancestors)
        for a in r.ancestors:  # an ancestor lies before, and is seen from its start
            assert a.run < k and a.chars <= runs[a.run].n_chars
        end += r.n_chars
        for x in r.loss:
            assert "<|im" not in r.text[x.start : x.start + x.length]


def test_escape(spark):
    odd = ["", "\\", "a\\\\b", *C.FOREIGN, C.START + C.SEP + C.END, "<\\|im_end|>", "\\[INST]", "[\\/INST]\\"]
    df = spark.createDataFrame([(x,) for x in odd], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.withColumn("back", C.unescape(F.col("e"))).collect():
        assert r.back == r.t
        assert not any(c in r.e for c in (C.START, C.SEP, C.END, *C.FOREIGN))


def test_empty(spark):
    assert chat_digest(frame(spark, ROWS).limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op6_chat_tree(spark, sf).collect()} == digest(rows)
