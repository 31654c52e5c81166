import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrivo.llm.chat_format import chat_digests, format_chats, read_chats

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("turns", T.StringType())])
PIECES = ["\\", "\\b", "\\l", "\\h", "#", "### ", "assistant: ", "<and>", "</turn>\n", "</turn>", "<", "a", "é🙂", "", ":", "\n", "b", "l", "h"]


def rows(seed):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            out.append((conv, rng.choice([turn, turn, 1, None]), rng.choice(["user", "assistant", "assistant", None, "a: #\\c"]), rng.choice([None, *["".join(rng.choices(PIECES, k=rng.randrange(6))) for _ in range(4)]]), "x"))
    return out + [(99, 0, "assistant", "long " * 100_000, "x")]


def test_round_trip(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {r.conv_id: r for r in chat_digests(df).collect()}
    back = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    made = {r.conv_id: r for r in format_chats(df).collect()}
    groups = {}
    for conv, turn, role, text, _ in data:
        groups.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    assert got.keys() == groups.keys()
    for conv, g in groups.items():
        g = [(r.decode(), t.decode()) for _, r, t in sorted(g)]
        assert [(t.role, t.text) for t in back[conv].turns] == g
        loss = "".join(t for r, t in g if r == "assistant")
        assert back[conv].loss_text == loss
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(g), len(loss), len(made[conv].formatted))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in g).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        blocks = sum(i == 0 or g[i - 1][0] != g[i][0] for i in range(len(g)))
        assert made[conv].formatted.count("</turn>\n") == blocks == made[conv].formatted.count("### ")
    assert chat_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_template(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "a<b", ""), (1, 2, "assistant", "c", "")], SCHEMA)
    r = format_chats(df).first()
    assert r.formatted == "### user: hi</turn>\n### assistant: a\\lb<and>c</turn>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["a\\lb", "c"] and r.asDict().keys() == {"conv_id", "formatted", "loss"}
    plan = format_chats(df.withColumn("x", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
