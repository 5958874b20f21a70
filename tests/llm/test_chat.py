import random

from pyspark.sql import functions as F

from registryloom.llm import chat

TREE = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def back(df):
    out = df.withColumn("turns", chat.read_back(F.col("formatted")))
    out = out.withColumn("learned", chat.learned_text(F.col("formatted"), F.col("spans")))
    return {(r.conv_id, r.branch): r for r in out.collect()}


def test_branches_rank_by_mean_score_then_leaf(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0),
        (1, 2, 1, "assistant", "good", 3.0),
        (1, 3, 1, "assistant", "bad", 0.0),
        (1, 4, 2, "user", "more", 2.0),
        (1, 5, 2, "user", "tie", 2.0),
        (2, 9, 77, "user", "its parent is missing", None),
        (None, 1, None, "assistant", None, None),
        (3, 1, 2, "user", "ring", 1.0),
        (3, 2, 1, "user", "ring", 1.0),
    ]
    got = back(chat.format_trees(spark.createDataFrame(rows, TREE), best=2))
    paths = {k: [t.text for t in r.turns] for k, r in got.items()}
    assert paths == {
        (1, 1): ["q", "good", "more"],
        (1, 2): ["q", "good", "tie"],
        (2, 1): ["its parent is missing"],
        (None, 1): [""],
    }
    assert got[1, 1].learned == "good" and got[1, 1].score == 2.0 and got[1, 1].n_turns == 3


def test_control_strings_come_back(spark):
    rng = random.Random(2)
    bits = ["\\", "</turn>", "###", "### assistant: ", ": ", "\n", "0", "1", "2", "3", "</tu", "rn>", "#", "é🙂", ""]
    rows, want = [], {}
    for conv in range(60):
        turns = []
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "sys: ###", None])
            text = rng.choice([None, "".join(rng.choices(bits, k=rng.randrange(9)))])
            rows.append((conv, turn, role, text))
            turns.append((role or "", text or ""))
        want[conv] = turns
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = back(chat.format_trees(chat.reply_chain(df)))
    for conv, turns in want.items():
        r = got[conv, 1]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count("</turn>") == len(turns)


def test_deep_chains_and_ties(spark):
    rows = [(5, i, "user" if i % 2 else "assistant", str(i)) for i in range(300)]
    rows += [(6, 0, "user", "b"), (6, 0, "user", "a"), (6, 0, "user", "a"), (6, None, None, "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = back(chat.format_trees(chat.reply_chain(df)))
    assert [t.text for t in got[5, 1].turns] == [str(i) for i in range(300)]
    assert [t.text for t in got[6, 1].turns] == ["first", "a", "a", "b"]


def test_no_messages(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_trees(chat.reply_chain(df)).count() == 0
