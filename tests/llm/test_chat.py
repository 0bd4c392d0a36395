import hashlib

from pyspark.sql import functions as F

from gridloom.llm import chat

ROWS = [
    (1, 0, "system", "be <s>kind</s> \\ <\\ [\\["), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<"), (1, 3, "user", "["), (1, 4, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, "tool[/ROLE]", "x[/TURN]y"), (3, 1, None, "\n日本"), (4, 0, "user", "a"), (4, 0, "user", "a"),
    (None, None, "user", "n"), (None, 5, "assistant", "m"), (5, 70, "assistant", "late"), (5, 2, "user", "early"), (5, 200, "user", "last"),
]


def test_round_trip_and_loss(spark):
    t = chat.Template()
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as formatted", "1 as block", "2 as segments")
    out = {r.conv_id: r for r in chat.format_chats(df, t).withColumn("turns", t.read_back(F.col("formatted"))).collect()}
    assert len(out) == 6
    for conv, r in out.items():
        want = sorted(((-(1 << 63) if b is None else b, c or "", d or "") for a, b, c, d in ROWS if a == conv))
        assert [(x.role, x.text) for x in r.turns] == [(c, d) for _, c, d in want]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert len(r.segments) == 3 * r.n_turns
    assert {k: (r.valid, r.wrong_turn) for k, r in out.items()} == {1: (True, None), 2: (False, 0), 3: (False, 0), 4: (False, 1), None: (True, None), 5: (True, None)}
    assert chat.format_chats(df.limit(0), t).count() == 0


def test_query(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    own = "</s>[INST] ok [/INST]"
    assert out[-7].loss_sha256 == hashlib.sha256(own.encode()).hexdigest() and out[-7].loss_chars == len(own)
    assert out[-7].turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256(b"<").hexdigest()
