import random

from pyspark.sql import functions as F

from quarry.llm import chat, queries

NASTY = ["", None, "</s>[INST] ok [/INST]", "\\", "a\\\\b<\\|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<<s><s></s>", "é\n\n", "[/INST][/INST]<</SYS>><<SYS>>", "$1 \\1 <|endoftext|>"]


def test_escape_round_trip(spark):
    rnd = random.Random(2)
    bits = ["<", "|", "im_start", "im_end", "|>", "\\", "[", "INST", "]", "/", "s", ">", "x", "\n"]
    texts = NASTY + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == (r.t or "")
        assert not any(c in r.e for c in chat.CONTROL)


def test_tree_paths(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", "high", 2.0), (1, 4, 3, "user", "again", None),
        (1, 5, 4, "assistant", "end", 0.5), (1, 5, 4, "assistant", "end", 0.5), (2, 1, 9, None, None, None), (3, 1, 2, "a", "loop", 1.0), (3, 2, 1, "a", "loop", 1.0), (4, 1, 1, "user", "self", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("x"))
    paths = {(r.tree, r.leaf, r.node, r.up) for r in chat.leaf_paths(df).collect()}
    assert paths == {(1, 2, 2, 0), (1, 2, 1, 1), (1, 5, 5, 0), (1, 5, 4, 1), (1, 5, 3, 2), (1, 5, 1, 3), (2, 1, 1, 0), (4, 1, 1, 0)}
    out = {(r.tree, r.branch): r for r in chat.format_trees(df, 2).withColumn("back", chat.read_chat(F.col("chat"))).collect()}
    assert sorted(out) == [(1, 1), (1, 2), (2, 1), (4, 1)]
    assert [tuple(m) for m in out[1, 1].back] == [("user", "root"), ("assistant", "high"), ("user", "again"), ("assistant", "end")]
    assert [out[1, 1].chat[s.begin : s.end] for s in out[1, 1].loss_spans] == ["high", "end"]
    assert [tuple(m) for m in out[2, 1].back] == [("", "")]


def test_query_against_brute_force(spark, tmp_path):
    import hashlib

    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "two\nlines", "\\\n", "\\n<s>\n\n", "[INST]\\"]), rnd.choice(NASTY + ["plain text"])) for c in range(40) for t in range(rnd.randint(1, 20))]
    rows += [(7, 2, "user", "same turn"), (7, 2, "user", "same turn"), (None, 0, "assistant", "no id"), (50, None, "assistant", "x" * 50000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op8_reply_trees(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = sorted(((t if t is not None else -1, role or "", text or "") for k, t, role, text in rows if k == c))
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_tails_below_cycles(spark):
    """Messages that hang on a cycle have no root, however long the table; other trees keep all their paths."""
    rows = [(1, n, n - 1 if n > 1 else None, "user", f"m{n}", 1.0) for n in range(1, 200)]
    rows += [(2, 1, 2, "user", "round", 1.0), (2, 2, 1, "user", "round", 1.0), (2, 3, 2, "user", "tail", 1.0), (2, 4, 3, "user", "tail", 1.0), (2, 9, None, "user", "alone", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    paths = [(r.tree, r.leaf, r.node, r.up) for r in chat.leaf_paths(df).collect()]
    assert sorted(paths) == sorted([(1, 199, n, 199 - n) for n in range(1, 200)] + [(2, 9, 9, 0)])
    pure = df.where("tree = 2 and node < 4")
    assert chat.leaf_paths(pure).count() == 0 and chat.format_trees(pure).count() == 0
