"""Reply trees as training conversations.

Messages point to the message they answer. Joins of the table with itself, each time over twice
the distance, find how deep every leaf lies and collect its path to the root; the best-scored
paths of each tree are then written out under one template, each with the spans to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registryloom.llm.common import saved

#: The template. A turn is OPEN, role, MID, text, CLOSE.
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: What must not occur inside a text, and how it is written there; the escape sign goes first and
#: comes back last. Roles must not hold the middle mark either.
TEXT_ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("###", "\\2"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\3"))
LEARNED_ROLE = "assistant"


def escape(c: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, written in escapes:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, written in reversed(escapes):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def reply_chain(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations: each turn answers the one before it.

    Rows are ordered by turn (nulls first), then role and text, so that repeated turns have a
    defined place; each stays a turn of its own. Null conversation ids form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("bigint")
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    chain = turns.select("conv_id", at.alias("msg_id"), "role", "text")
    return chain.withColumn("parent_id", parent).withColumn("score", F.lit(0.0))


def leaf_paths(messages: DataFrame) -> DataFrame:
    """``conv_id, leaf_id, msg_id, up``: every message on the way from each leaf, ``up`` steps above.

    Round k joins the table of pointers over 2^k replies with itself; the paths then grow by the
    same pointers, longest first. A tree of depth d takes about 2 log2(d) joins, and the pointers
    of one round hold at most one row a message. A parent that does not exist makes its child a
    root; replies in a ring have no leaf below them and thus no path.
    """
    links = messages.select("conv_id", "msg_id", "parent_id")
    known = messages.select("conv_id", F.col("msg_id").alias("parent_id"))
    real = links.alias("a").join(known.alias("b"), _same("parent_id", "parent_id"), "left_semi")
    hops = saved(real.select("conv_id", "msg_id", F.col("parent_id").alias("above")))
    answered = hops.select("conv_id", F.col("above").alias("msg_id"))
    leaves = links.alias("a").join(answered.alias("b"), _same("msg_id", "msg_id"), "left_anti")
    paths = leaves.select(
        "conv_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("bigint").alias("up")
    )

    rounds, limit = [hops], messages.count().bit_length() + 1
    while len(rounds) <= limit:
        far = hops.alias("a").join(hops.alias("b"), _same("above", "msg_id"))
        hops = saved(far.select("a.conv_id", "a.msg_id", "b.above"))
        if hops.isEmpty():
            break
        rounds.append(hops)
    for k in reversed(range(len(rounds))):
        higher = paths.alias("a").join(rounds[k].alias("b"), _same("msg_id", "msg_id"))
        up = (F.col("up") + 2**k).alias("up")
        reached = higher.select("a.conv_id", "leaf_id", F.col("b.above").alias("msg_id"), up)
        paths = saved(paths.unionByName(reached))
    return paths


def _same(left: str, right: str) -> Column:
    conv = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    return conv & (F.col(f"a.{left}") == F.col(f"b.{right}"))


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """``conv_id, branch, score, n_turns, formatted, spans``: the best branches of each tree.

    ``messages`` holds ``conv_id, msg_id, parent_id, role, text, score``, with message ids that
    are unique in a conversation. Branches rank by their mean score, then by leaf id, from 1. A
    null text or role counts as empty, a null score as 0. ``spans`` are the places ``start,
    length`` in ``formatted``, counted in code points from 0, that hold the texts to learn from.
    Other columns are ignored; an empty table gives no rows. A conversation is one row of the
    result, so one branch must fit in a cell.
    """
    text = escape(F.coalesce("text", F.lit("")))
    role = escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES)
    head = F.concat(F.lit(OPEN), role, F.lit(MID))
    written = messages.select(
        "conv_id",
        "msg_id",
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.concat(head, text, F.lit(CLOSE)).alias("turn"),
        F.length(head).alias("head_chars"),
        F.length(text).alias("text_chars"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
    )
    paths = leaf_paths(messages)
    scores = written.select("conv_id", "msg_id", "score")
    scored = paths.alias("a").join(scores.alias("b"), _same("msg_id", "msg_id"))
    branches = scored.groupBy("a.conv_id", "leaf_id").agg(F.avg("score").alias("score"))
    rank = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf_id")
    chosen = branches.withColumn("branch", F.row_number().over(rank)).filter(F.col("branch") <= best)

    steps = paths.alias("a").join(chosen.alias("b"), _same("leaf_id", "leaf_id"))
    steps = steps.select("a.conv_id", "a.msg_id", "up", "branch", "b.score")
    parts = steps.alias("a").join(written.drop("score").alias("b"), _same("msg_id", "msg_id"))
    turn = F.struct((-F.col("up")).alias("at"), "turn", "head_chars", "text_chars", "learned")
    whole = parts.groupBy("a.conv_id", "branch", "a.score").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )
    return whole.select(
        "conv_id",
        "branch",
        "score",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        _spans(F.col("turns")).alias("spans"),
    )


def _spans(turns: Column) -> Column:
    """Places of the learned texts, by running lengths of the turns before them."""
    tail = len(CLOSE)
    empty = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
    )

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + t["head_chars"]
        span = F.array(F.struct(start.alias("start"), t["text_chars"].alias("length")))
        spans = F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"])
        after = start + t["text_chars"] + tail
        return F.struct(after.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, add, lambda s: s["spans"])


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text, as ``array<struct<role, text>>``."""
    whole = F.split(formatted, CLOSE)
    turns = F.slice(whole, 1, F.size(whole) - 1)  # nothing follows the last mark

    def parse(t: Column) -> Column:
        body = F.substr(t, F.lit(len(OPEN) + 1))
        mid = F.instr(body, MID)
        role = F.substr(body, F.lit(1), mid - 1)
        text = F.substr(body, mid + len(MID))
        return F.struct(
            unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text")
        )

    return F.transform(turns, parse)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the spans, unescaped, in order."""
    pieces = F.transform(
        spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))
    )
    return F.array_join(pieces, "")
