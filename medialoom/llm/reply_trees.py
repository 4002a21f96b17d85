"""Reply trees formatted as conversations, with built-in functions and self-joins only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialoom.session import materialize

# The marks of a turn, and the control strings of common chat templates, by their first character.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = ((r"<", r"/?s>|</?SYS>>|\|[A-Za-z0-9_]+\|>"), (r"\[", r"/?INST\]"))
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """A control string gets a backslash after its first character, and one that has backslashes there one more."""
    for first, rest in CONTROL:
        text = F.regexp_replace(text, rf"({first})(\\*)({rest})", r"$1\\$2$3")
    return text


def unescaped(text: Column) -> Column:
    for first, rest in reversed(CONTROL):
        text = F.regexp_replace(text, rf"({first})\\(\\*)({rest})", "$1$2$3")
    return text


def role_written(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def role_read(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def tree_key(conv: Column) -> Column:
    """Conversation ids as text; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def replies_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as messages, each a reply to the one before: ``(conv, msg, parent, role, text, score)``.

    A message's id is made of turn, role and a digest of the text, so texts are not moved to number them. Equal turns are
    in order of role and digest, null turns come first, null roles and texts are empty, and repeated rows share an id.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), by.alias("role"), said.alias("text")).withColumn("digest", F.md5("text"))
    rows = rows.withColumn("msg", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("-")), "digest", "role"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "digest")
    ids = rows.groupBy(tree_key(F.col("conv")).alias("tree"), "turn", "role", "digest", "msg").agg(F.lit(1))
    parents = ids.withColumn("parent", F.lag("msg").over(order)).select("tree", "msg", "parent", F.lit(0.0).alias("score"))
    return rows.select("conv", "msg", "role", "text"), parents


def nodes_of(messages: DataFrame) -> DataFrame:
    """One row per message id: ``(tree, msg, parent, score)``."""
    key = tree_key(F.col("conv")).alias("tree")
    return messages.where("msg IS NOT NULL").groupBy(key, "msg").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))


def climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and total score of every message, and per k the table from messages to their 2^k-th ancestors.

    Each self-join doubles the distance of the ancestor a message knows, so there are about log2(longest path) of them;
    messages that have reached their root are done. Messages on or below a circle of replies never are, and stay out.
    """
    above = nodes.select("tree", F.col("msg").alias("up"))
    first = nodes.select("tree", "msg", F.when(F.col("parent") != F.col("msg"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    first = first.join(above.withColumn("there", F.lit(True)), ["tree", "up"], "left")
    state = first.select("tree", "msg", F.when(F.col("there"), F.col("up")).alias("up"), "total", F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("steps"))
    state = materialize(state, "climb")
    most = math.ceil(math.log2(max(2, state.count()))) + 1
    jumps = []
    while len(jumps) <= most and not (climbing := state.where("up IS NOT NULL")).isEmpty():
        jumps.append(climbing.select("tree", "msg", "up"))
        held = state.select("tree", F.col("msg").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("on"))
        moved = climbing.join(held, ["tree", "up"]).select("tree", "msg", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("on")).alias("steps"))
        state = materialize(state.where("up IS NULL").unionByName(moved), "climb")
    return state.where("up IS NULL").select("tree", "msg", "total", F.col("steps").alias("depth")), jumps


def chosen_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """``(tree, branch, msg, pos)``: the messages of the best root-to-leaf paths of every conversation, in order.

    Branches are ranked by total score, then by length, then by the leaf's id. From a chosen leaf the path is filled in
    by jumps of falling powers of two, so every self-join at most doubles the rows.
    """
    nodes = materialize(nodes, "messages")
    done, jumps = climbed(nodes)
    if jumps:
        done = done.join(jumps[0].select("tree", F.col("up").alias("msg")).distinct(), ["tree", "msg"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "msg"))
    path = done.withColumn("branch", rank).where(F.col("branch") <= branches).select("tree", "branch", "msg", F.col("depth").alias("pos"))
    path = materialize(path, "paths")
    for k, jump in reversed(list(enumerate(jumps))):
        up = path.join(jump, ["tree", "msg"]).select("tree", "branch", F.col("up").alias("msg"), (F.col("pos") - (1 << k)).alias("pos"))
        path = materialize(path.unionByName(up), "paths")
    return path


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """``(conv, branch, n_turns, formatted, mask)`` from ``(conv, msg, role, text)`` and the chosen paths.

    Texts are shuffled once, by conversation. ``mask`` holds the places of the learned texts in code points.
    """
    rows = messages.select(
        tree_key(F.col("conv")).alias("tree"), F.struct("conv").alias("conv"), F.col("msg"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    both = rows.unionByName(paths.withColumn("mark", F.struct("pos", "branch")).select("tree", "msg", "mark"), allowMissingColumns=True).repartition("tree")
    marks = F.collect_list("mark").over(Window.partitionBy("tree", "msg"))
    turns = both.withColumn("marks", marks).where("conv IS NOT NULL").select("tree", "conv", "role", "text", F.inline("marks"))
    turns = turns.withColumns({"said": escaped(F.col("text")), "head": F.concat(F.lit(OPEN), role_written(F.col("role")), F.lit("\n"))})
    piece = F.concat("head", "said", F.lit(CLOSE))
    order = Window.partitionBy("tree", "branch").orderBy("pos", "role", "text")
    before = F.sum(F.length(piece).cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumns({"at": F.coalesce(before, F.lit(0)) + F.length("head"), "no": F.row_number().over(order)})
    span = F.when(F.col("role") == LEARNED, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("said")).alias("stop")))
    parts = F.array_sort(F.collect_list(F.struct("no", piece.alias("piece"), span.alias("span"))))
    per = turns.groupBy("tree", "branch").agg(F.first("conv").alias("conv"), parts.alias("parts"))
    return per.select(
        F.col("conv.conv").alias("conv"),
        "branch",
        F.size("parts").cast("bigint").alias("n_turns"),
        F.array_join("parts.piece", "").alias("formatted"),
        F.filter("parts.span", lambda s: s.isNotNull()).alias("mask"),
    )


def format_chats(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of every reply tree, each as one conversation.

    ``messages`` has ``conv, msg, parent, role, text, score``; the result ``conv, branch`` (from 1), ``n_turns``,
    ``formatted`` and ``mask``, the spans (code points, end exclusive) of the assistant's texts. A turn is written as
    ``<|im_start|>role``, a line feed, the text and ``<|im_end|>``; control strings inside texts and roles are escaped
    so that ``read_back`` finds what was put in.

    A null conversation is one of its own. Messages without an id take no part; a parent that is not there, or the
    message itself, makes a root; messages on or below a circle of replies are left out. Rows that repeat an id are
    parts of one message, each a turn at its place, in order of role and text, under the smallest parent and with the
    highest score. Null scores are 0, null roles and texts empty. A text may be as long as a string can be; one
    conversation is one row of the result, so it must fit into a task. Other columns are ignored; an empty table gives
    an empty result.
    """
    return format_paths(messages.where("msg IS NOT NULL"), chosen_paths(nodes_of(messages), branches))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``format_chats`` of plain conversations, whose rows are in order of turn, each replying to the one before."""
    messages, parents = replies_of_turns(turns, conv, turn, role, text)
    return format_paths(messages, chosen_paths(parents, 1)).withColumnRenamed("conv", conv)


def read_back(formatted: Column, mask: Column) -> dict[str, Column]:
    """Roles, texts and the learned text, taken from the formatted string alone and from the mask."""
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    learned = F.transform(mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), (m["stop"] - m["start"]).cast("int"))))
    return {"roles": F.transform(roles, role_read), "texts": F.transform(texts, unescaped), "learned": F.array_join(learned, "")}
