"""Chat formatting of reply trees.

Messages point to the message they answer.  Root-to-leaf paths are enumerated by self-joins with doubling steps: after k rounds every
leaf knows its 2^k nearest ancestors, so a thread of n messages takes log2(n) joins.  Branches are ranked by score and each chosen
path becomes one conversation in a template whose control strings cannot occur inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: The template: every turn is ``<|role|>text<|end|>``.  In roles and texts the four characters below are replaced, so neither the marks
#: nor those of other templates (they all hold ``<``, ``>`` or ``[``) can occur; undone in reverse order.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lsqb;"))


def escape(column: Column) -> Column:
    for plain, code in ESCAPES:
        column = F.replace(column, F.lit(plain), F.lit(code))
    return column


def unescape(column: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        column = F.replace(column, F.lit(code), F.lit(plain))
    return column


def chain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: (conv_id, node, parent, role, text, score).

    Rows of one conversation follow each other by turn, equal turns by role and text, repeated rows one after the other; null roles and
    texts are empty.  Each row answers the one before."""
    rows = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("node", node).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _join(a: DataFrame, b: DataFrame, keys: tuple[str, str], how: str = "inner") -> DataFrame:
    """``a`` and ``b`` (so aliased) of one conversation where a's first key is b's second; a null conversation is one, too."""
    return a.alias("a").join(b.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col(f"a.{keys[0]}") == F.col(f"b.{keys[1]}")), how)


def paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): for every leaf the nodes of its path to the root, ``up`` steps above it.

    ``nodes`` has (conv_id, node, parent), node unique in its conversation.  A parent that does not exist makes its child a root;
    nodes on a cycle, and leaves that lead into one, have no path."""
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    links = nodes.filter("parent is not null").select("conv_id", "node", "parent")
    links = up = stage(_join(links, nodes, ("parent", "node"), "left_semi"), "chat-up")
    reached = _join(nodes.select("conv_id", "node"), up, ("node", "parent"), "left_anti").select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    reached, step = stage(reached, "chat-path"), 1
    while not up.isEmpty():
        further = stage(_join(reached, up, ("node", "node")).select("a.conv_id", "leaf", "b.parent", (F.col("up") + step).alias("up")).withColumnRenamed("parent", "node"), "chat-path")
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        up, step = stage(_join(up, up, ("parent", "node")).select("a.conv_id", "a.node", "b.parent"), "chat-up"), step * 2
        if step >= 2 * most:  # longer than any path without a cycle
            roots = _join(nodes.select("conv_id", "node"), links, ("node", "node"), "left_anti")
            ended = _join(reached, roots, ("node", "node"), "left_semi").select("conv_id", "leaf")
            return _join(reached, ended, ("leaf", "leaf"), "left_semi")
    return reached


def ranked(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` paths of each conversation by mean score (null: 0), then length, then leaf: (conv_id, rank, leaf, node, up)."""
    scores = nodes.select("conv_id", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    way = stage(_join(paths(nodes), scores, ("node", "node")).select("a.*", "b.score"), "chat-ranked")
    totals = way.groupBy("conv_id", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    best = totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("conv_id", "leaf", "rank")
    return _join(way, best, ("leaf", "leaf")).select("a.conv_id", "rank", "a.leaf", "a.node", "a.up")


def conversations(nodes: DataFrame, top: int = 1, learned: str = "assistant") -> DataFrame:
    """(conv_id, rank, formatted, mask): each chosen path as one text, with the code point spans under the loss.

    The mask covers exactly the texts of role ``learned``: no marks, no other role.  A path is one row by nature."""
    turns = _join(ranked(nodes, top), nodes.select("conv_id", "node", "role", "text"), ("node", "node")).select(
        "a.conv_id", "rank", "up", "role", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id", "rank").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("start", start).select(
        "conv_id", "rank", F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("turn")).alias("piece"),
        F.when(F.col("role") == learned, F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))).alias("span"))
    return placed.groupBy("conv_id", "rank").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["turn"]), "").alias("formatted"), F.array_sort(F.collect_list("span")).alias("mask"))


def turns(formatted: Column) -> Column:
    """Array of (role, text) read back from the template."""
    parts = F.split(formatted, r"<\|end\|>", -1)
    head = len(OPEN) + 1
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, head, 1 << 30), CLOSE, 1)).alias("role"),
        unescape(F.substring(p, F.locate(CLOSE, p) + len(CLOSE), F.length(p))).alias("text")))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return unescape(F.array_join(F.transform(mask, lambda m: F.substring(formatted, m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int"))), ""))
