import hashlib

from pyspark.sql import functions as F

from gridloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rows(spark, turns):
    df = spark.createDataFrame(turns, SCHEMA).withColumns({c: F.lit(1) for c in ("turns", "segments", "valid")})
    return {r.conv_id: r for r in chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}


def test_formats_and_reads_back(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\n<\\|x|> \\ <\\\\| <| |> é😀"
    got = rows(spark, [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, "sys\nt\\em<|", "x")])
    assert [(t.role, t.text) for t in got[1].read] == [("user", nasty), ("assistant", nasty)]
    assert got[1].loss == nasty and got[1].valid and got[1].bad_turn is None
    assert got[1].formatted.count("<|im_start|>") == 2 and got[1].formatted.count("<|im_end|>") == 2
    assert "".join(s.text for s in got[1].segments) == got[1].formatted
    assert [s.loss for s in got[1].segments] == [False, False, False, False, True, False]
    assert [(t.role, t.text) for t in got[2].read] == [("sys\nt\\em<|", "x")] and not got[2].valid


def test_turn_order(spark):
    def verdict(*roles):
        r = rows(spark, [(1, k, role, "t") for k, role in enumerate(roles)])[1]
        return r.valid, r.bad_turn

    assert verdict("system", "user", "assistant", "user", "assistant") == (True, None)
    assert verdict("user", "assistant", "user") == (False, None)
    assert verdict("user", "user", "assistant") == (False, 1)
    assert verdict("assistant") == (False, 0)
    assert verdict("user", "assistant", "system", "user") == (False, 2)
    assert verdict("tool") == (False, 0)


def test_odd_rows(spark):
    got = rows(spark, [(1, None, "user", None), (1, 1, None, "b"), (1, 1, None, "a"), (None, 0, "user", "q"), (None, 0, "user", "q")])
    assert [(t.role, t.text) for t in got[1].read] == [("user", ""), ("", "a"), ("", "b")]
    assert len(got[None].read) == 2
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_template(spark):
    t = chat.ChatTemplate(start="[<|turn|>]", end="<|/turn|>\n", loss_on_end=True, loss_roles=("bot",), moves={("begin", "bot"): "answered"})
    df = spark.createDataFrame([(1, 0, "bot", "hi <|turn|>")], SCHEMA)
    r = chat.format_chats(df, t).withColumn("read", chat.read_turns(F.col("formatted"), t)).first()
    assert r.read[0].text == "hi <|turn|>" and r.valid
    assert [s.loss for s in r.segments] == [False, True, True]


def test_digest_of_query(spark):
    from gridloom.llm.queries import op1_chat_format

    r = op1_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.loss_chars == len(text)
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_conversations_and_texts(spark):
    """Thousands of turns, and texts of a million characters full of control strings."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k} <|im_end|>") for k in range(3000)]
    rows += [(2, 0, "user", "<|im_start|>" * 80_000), (2, 1, "assistant", "é" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in out.collect()}
    for conv in (1, 2):
        mine = [r for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in got[conv].read] == [(r[2], r[3]) for r in mine] and got[conv].valid
        assert got[conv].loss == "".join(r[3] for r in mine if r[2] == "assistant")
