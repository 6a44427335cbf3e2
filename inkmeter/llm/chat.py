"""Chat formatting of reply trees.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

# The template.  A turn is "### role: text</turn>" and a line feed.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>"
SPOKEN = "assistant"


def escape(text: Column) -> Column:
    """Backslashes are doubled; # and the slash of the turn end get one before them, so no control string is left."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("#"), F.lit("\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, node_id, depth): the nodes of the ``branches`` best root-to-leaf paths of each tree.

    ``nodes`` has tree_id, node_id (unique in its tree), parent_id (null, or of no node: a root) and score.  Self-joins
    double each node's pointer to an ancestor, so paths of length d take log2(d) rounds; score and depth of the path
    up to the root add up on the way.  Leaves are ranked by the mean score of their path (null: 0), then depth, then
    id, and the nodes of the chosen ones are found by the same pointers, the longest first.  Nodes on a cycle reach no
    root and are on no path.  Each round is written to the shared folder: no round depends on an executor that held
    an earlier one.
    """
    base = nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = base.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"))
    known = base.join(ids, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("parent_id") == F.col("_node")), "left")
    step = checkpointed(known.select("tree_id", "node_id", F.col("_node").alias("up"), "score", F.lit(1).cast("long").alias("depth")))
    n = step.count()
    jumps = []
    for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):
        going = step.where("up is not null")
        if going.isEmpty():
            break
        jumps.append(going.select("tree_id", "node_id", "up"))
        above = step.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("depth").alias("_depth"))
        joined = going.join(above, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_node")))
        going = joined.select("tree_id", "node_id", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("depth") + F.col("_depth")).alias("depth"))
        step = checkpointed(going.unionByName(step.where("up is null")))
    rooted = step.where("up is null").drop("up")
    parents = base.where("parent_id is not null").select(F.col("tree_id").alias("_tree"), F.col("parent_id").alias("_node")).distinct()
    leaves = rooted.join(parents, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("node_id") == F.col("_node")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "node_id"))
    path = leaves.select("tree_id", "node_id", rank.alias("branch")).where(F.col("branch") <= branches)
    for jump in reversed(jumps):
        up = jump.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), "up")
        higher = path.join(up, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("node_id") == F.col("_node")))
        path = checkpointed(path.unionByName(higher.select("tree_id", F.col("up").alias("node_id"), "branch")))
    depth = rooted.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), "depth")
    return path.join(depth, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("node_id") == F.col("_node"))).select("tree_id", "branch", "node_id", "depth")


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` as a reply tree each: every turn answers the one before it.

    Order: turn (null first), then role and text, so equal turns have a fixed order.  Null roles and texts are empty.
    The score of a turn is its number of characters.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    numbered = rows.select("conv_id", number.cast("long").alias("node_id"), "role", "text")
    return numbered.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.char_length("text").cast("double")).withColumnRenamed("conv_id", "tree_id")


def formatted(turns: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree_id, branch, formatted, mask): each path as one conversation.

    ``mask`` has for each turn where it starts and, for an assistant's, from where to where the loss counts, in code
    points of ``formatted``: its text alone, without header and end (else both are null).
    """
    of = paths.select(F.col("tree_id").alias("_tree"), F.col("node_id").alias("_node"), "branch", "depth")
    told = turns.join(of, F.col("tree_id").eqNullSafe(F.col("_tree")) & (F.col("node_id") == F.col("_node")))
    head = F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(MIDDLE))
    cut = told.select("tree_id", "branch", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(TAIL) + 1
    before = Window.partitionBy("tree_id", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    spoken = F.when(F.col("role") == SPOKEN, F.col("start") + F.char_length("head"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(TAIL + "\n")).alias("turn"), "start", spoken.alias("loss_start"), (spoken + F.char_length("body")).alias("loss_end"))
    grouped = placed.groupBy("tree_id", "branch").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    mask = F.arrays_zip(F.col("t.depth").alias("depth"), F.col("t.start").alias("start"), F.col("t.loss_start").alias("loss_start"), F.col("t.loss_end").alias("loss_end"))
    return grouped.select("tree_id", "branch", F.array_join("t.turn", "").alias("formatted"), mask.alias("mask"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(tree_id, branch, formatted_chars, depth, role, text, loss) of every turn, parsed from ``formatted`` and ``mask``.

    ``loss`` is null outside the mask.
    """
    part = F.split("formatted", TAIL + "\n", -1)
    zipped = F.arrays_zip(F.slice(part, F.lit(1), F.size("mask")).alias("part"), F.col("mask").alias("mask"))
    chars = F.char_length("formatted").cast("long").alias("formatted_chars")
    rows = conversations.select("tree_id", "branch", chars, F.inline(zipped))
    role = F.regexp_extract("part", r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)
    named = rows.select("tree_id", "branch", "formatted_chars", F.col("mask.depth").alias("depth"), "part", role.alias("role"), (F.col("mask.loss_start") - F.col("mask.start")).alias("at"), (F.col("mask.loss_end") - F.col("mask.loss_start")).alias("n"))
    text = F.expr(f"substring(part, length(role) + {len(HEAD) + len(MIDDLE) + 1})")
    loss = F.expr("substring(part, cast(at + 1 as int), cast(n as int))")
    return named.select("tree_id", "branch", "formatted_chars", "depth", unescape(F.col("role")).alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"))


def format_conversations(conversations: DataFrame, branches: int = 1) -> DataFrame:
    """(tree_id, branch, formatted, mask) of all ``conversations`` (conv_id, turn, role, text), rows by turn.

    Ids may be null (a conversation of its own), roles and texts too (empty); other columns are ignored; no rows give
    none.
    """
    turns = turns_of(conversations)
    return formatted(turns, best_paths(turns.select("tree_id", "node_id", "parent_id", "score"), branches))


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars by tree and branch."""
    turn = F.struct("depth", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("told"), F.coalesce("loss", F.lit("")).alias("loss"))
    grouped = read_back(conversations).groupBy("tree_id", "branch")
    back = grouped.agg(F.sort_array(F.collect_list(turn)).alias("t"), F.max("formatted_chars").alias("formatted_chars"))
    told, loss = F.array_join("t.told", ""), F.array_join("t.loss", "")
    return back.select(
        "tree_id", "branch", F.size("t").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )
