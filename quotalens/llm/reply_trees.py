"""Chat texts from reply trees: root-to-leaf paths by self-joins, ranked by score, one formatted chat each.

A message knows the message that it replies to.  Doubling joins a table of jumps with itself: after round k
every message knows its 2^k-th ancestor, so the number of joins follows the logarithm of the depth.  The
same jumps, from the longest to the shortest, then spread each leaf over all its ancestors.  Texts are
joined last, only to the paths that were chosen.

Template: ``<|im_start|>`` role, line break, text, ``<|im_end|>``, line break.  Inside a text every ``<|``,
also one already parted by backslashes, gets one backslash more, so no text holds a mark and the text can
be read back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from quotalens.llm.store import released, saved

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)
#: Scores are added in these units, as whole numbers, so that no order of addition can change a rank.
SCORE_UNIT = 1e-6
#: Escapes of a role, undone in reverse order.
_ROLE_ESCAPES = (("%", "%25"), ("\n", "%0A"), ("|", "%7C"))


def escape(text: Column) -> Column:
    """The text without ``<|``; ``unescape`` gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_escaped(role: Column) -> Column:
    for plain, code in _ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_plain(role: Column) -> Column:
    for plain, code in reversed(_ROLE_ESCAPES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _nodes(messages: DataFrame) -> DataFrame:
    """(tree, node, parent, units, role, text), one row per message, under keys that are never null."""
    tree = F.coalesce(F.concat(F.lit("t"), F.col("tree_id").cast("string")), F.lit("-"))
    score = F.col("score").cast("double")
    units = F.when(score.isNull() | F.isnan(score), 0).otherwise(F.rint(score / SCORE_UNIT).cast("long"))
    content = F.sha2(F.to_json(F.struct("parent_id", "role", "text", "score")), 256)
    node = F.coalesce(F.concat(F.lit("i"), F.col("message_id").cast("string")), F.concat(F.lit("h"), content))
    rows = messages.select(
        tree.alias("tree"), node.alias("node"), F.concat(F.lit("i"), F.col("parent_id").cast("string")).alias("parent"), units.alias("units"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    best = F.struct((-F.col("units")).alias("u"), "parent", "role", "text")
    return rows.groupBy("tree", "node").agg(F.min(best).alias("b")).select("tree", "node", "b.parent", (-F.col("b.u")).alias("units"), "b.role", "b.text")


def _ranked(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group with their rank; Spark cuts each task's rows to as many before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def tree_paths(links: DataFrame, best_replies: int | None = None, paths_per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, node, above): the chosen paths, one row per message, ``above`` messages over the leaf.

    ``links`` holds tree, node (unique in its tree), parent and units.  Children of one message, and roots of
    one tree, are ranked by units, then by node; only ``best_replies`` of each are followed.  Paths are
    ranked by the mean of their units, then by leaf; ``paths_per_tree`` are chosen, None takes all.
    A parent that does not exist makes a root.  Messages on or below a cycle have no root and lie on no path.
    """
    links = saved(links.select("tree", "node", "parent", "units"), "links")
    known = links.select(F.col("tree").alias("of"), F.col("node").alias("known"))
    at_parent = (links["tree"] == known["of"]) & (links["parent"] == known["known"])
    kept = links.join(known, at_parent, "left").select("tree", "node", F.col("known").alias("up"), "units")
    if best_replies is not None:
        kept = _ranked(kept, ["tree", "up"], [F.col("units").desc(), F.col("node")], best_replies).drop("rank")
    kept = saved(kept, "kept")

    # (tree, node, up): up is 2^k messages above; a message without such an ancestor is in no later table
    jumps = [saved(kept.where("up IS NOT NULL").select("tree", "node", "up"), "jump-0")]
    rounds = math.ceil(math.log2(max(2, links.count())))
    while not (done := jumps[-1].isEmpty()) and len(jumps) <= rounds:
        here = jumps[-1]
        there = here.select(F.col("tree").alias("of"), F.col("node").alias("mid"), F.col("up").alias("far"))
        further = here.join(there, (here["tree"] == there["of"]) & (here["up"] == there["mid"]))
        jumps.append(saved(further.select("tree", "node", F.col("far").alias("up")), f"jump-{len(jumps)}"))

    parents = kept.where("up IS NOT NULL").select("tree", F.col("up").alias("node"))
    leaves = kept.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    if done:
        jumps.pop()
    else:  # as many ancestors as messages: on or below a cycle
        leaves = leaves.join(jumps[-1], ["tree", "node"], "left_anti")
    spread = saved(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "spread")
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("tree").alias("of"), F.col("node").alias("mid"), "up")
        higher = spread.join(step, (spread["tree"] == step["of"]) & (spread["node"] == step["mid"]))
        wider = saved(spread.union(higher.select("tree", "leaf", F.col("up").alias("node"), F.col("above") + F.lit(1 << k))), "spread")
        released(spread)
        released(jumps[k])
        spread = wider

    # a path counts from its root; one that ends below a reply that was not followed does not
    if best_replies is not None:
        roots = kept.where("up IS NULL").select("tree", "node")
        spread = spread.join(spread.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    worth = spread.join(kept.select("tree", "node", "units"), ["tree", "node"]).groupBy("tree", "leaf").agg((F.sum("units") / F.count("*") * F.lit(SCORE_UNIT)).alias("score"))
    if paths_per_tree is None:
        from quotalens.operators.ranking import row_numbers

        chosen = row_numbers(worth, "score", "leaf", "rank", keys=["tree"])
    else:
        chosen = _ranked(worth, ["tree"], [F.col("score").desc(), F.col("leaf")], paths_per_tree)
    return spread.join(chosen, ["tree", "leaf"]).select("tree", "leaf", F.col("rank").cast("long").alias("rank"), "score", "node", "above")


def format_trees(messages: DataFrame, best_replies: int | None = None, paths_per_tree: int | None = 1, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """One chat per chosen path: tree_id, leaf_id, rank, score, formatted, loss (spans of code points in formatted).

    ``messages`` needs tree_id, message_id, parent_id, role, text and score; other columns are ignored,
    whatever their names.  A null tree_id is a tree of its own.  Of rows that share tree_id and message_id
    the one of the highest score counts (then the least parent, role, text); rows without a message_id are
    told apart by their content, and nothing can reply to them (leaf_id null).  Null roles and texts are
    empty, a null or NaN score is 0.  Loss spans cover the escaped texts of ``loss_roles``, nothing else.  A chat is
    one value of at most 2 GB, whatever the number of its messages.  An empty table gives an empty table.
    """
    nodes = saved(_nodes(messages), "nodes")
    paths = tree_paths(nodes, best_replies, paths_per_tree)
    role, text = _role_escaped(F.col("role")), escape(F.col("text"))
    turns = paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "score", "above", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END)).alias("piece"),
        F.length(text).alias("width"), F.col("role").isin(*loss_roles).alias("learnt"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("above").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("end", F.sum(F.length("piece").cast("long")).over(before) - len(END))
    span = F.when(F.col("learnt"), F.struct((F.col("end") - F.col("width")).alias("start"), F.col("end").alias("end")))
    chats = turns.groupBy("tree", "leaf", "rank", "score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("a"), "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss"))
    kind = dict(messages.dtypes)
    return chats.select(
        F.when(F.col("tree") != "-", F.expr("substring(tree, 2)")).cast(kind["tree_id"]).alias("tree_id"),
        F.when(F.col("leaf").startswith("i"), F.expr("substring(leaf, 2)")).cast(kind["message_id"]).alias("leaf_id"),
        "rank", "score", F.array_join(F.col("pieces")["piece"], "").alias("formatted"), "loss")


def read_chats(chats: DataFrame, formatted: str = "formatted", loss: str = "loss") -> DataFrame:
    """The chats with ``turns`` (role, text) read back from the formatted text, and ``learnt``: the texts under the loss spans."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - 1 - len(END))
    turns = F.transform(pieces, lambda p: F.struct(_role_plain(head(p)).alias("role"), unescape(body(p)).alias("text")))
    learnt = F.transform(loss, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.withColumns({"turns": turns, "learnt": learnt})


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each row answers the row before it (null turns first, ties by role and text)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    number = F.row_number().over(order)
    rows = turns.select("conv_id", "role", "text", number.cast("long").alias("message_id"))
    return rows.select(F.col("conv_id").alias("tree_id"), "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
