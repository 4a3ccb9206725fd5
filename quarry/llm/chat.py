"""Reply trees: enumerate root-to-leaf paths by self-joins, rank them, format each chosen one as a chat.

A message knows its parent.  Paths grow by doubling: after step s each message knows its ancestor 2**s
levels up, so a tree of depth d takes about log2(d) self-joins.  Only leaves then need their chain, which is
gathered by following those links for the leaves alone.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per message.  In a text (and a role) `\\` is doubled and a
`\\` is put after the first character of every control string; reading drops one `\\` before any character.
So no control string of the text survives and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Control strings of common chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
START, END = "<|im_start|>", "<|im_end|>\n"
_RESTS = "|".join(r"(?<=" + "\\" + c[0] + ")" + "".join("\\" + x if not x.isalnum() and x != "_" else x for x in c[1:]) for c in CONTROL)


def escape(text: Column) -> Column:
    """Reversibly break every control string; null counts as empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?={_RESTS})", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """As escape, and line breaks as `\\` and n, so that a role stays on its line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Between doubled `\\`, a `\\` and n is a line break: no control string has an n in second place."""
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n")))), "\\")


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, node, parent, ...) -> (tree, leaf, node, up): every message on the path of every leaf.

    up is the distance from the leaf.  A parent that is null, missing from its tree or the message itself
    makes a root; repeated (tree, node) rows count once.  Messages on a cycle, and below one, have no root; they are left out.
    """
    nodes = messages.select("tree", "node", "parent").dropDuplicates(["tree", "node"])
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    parent = nodes.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")) & (F.col("parent") != F.col("node")), "left")
    nodes = materialize(parent.select("tree", "node", F.col("n").alias("up1")), "parents")
    inner = nodes.where("up1 is not null").select("tree", F.col("up1").alias("node")).distinct()
    leaves = nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    # jumps[s]: the ancestor 2**s levels up, where there is one.
    jumps = [nodes.where("up1 is not null").select("tree", "node", F.col("up1").alias("far"))]
    total = nodes.count()
    while 2 ** len(jumps) < 2 * total:  # a jump as long as all messages goes round a cycle
        last = jumps[-1]
        ahead = last.select("tree", F.col("node").alias("far"), F.col("far").alias("farther"))
        longer = materialize(last.join(ahead, ["tree", "far"]).select("tree", "node", F.col("farther").alias("far")), "jumps")
        if longer.isEmpty():
            break
        jumps.append(longer)
    else:
        rootless = jumps[-1].select("tree", "node")
        leaves = leaves.join(rootless.toDF("tree", "leaf"), ["tree", "leaf"], "left_anti")
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for s in reversed(range(len(jumps))):
        hop = paths.join(jumps[s], ["tree", "node"]).select("tree", "leaf", F.col("far").alias("node"), (F.col("up") + 2**s).alias("up"))
        paths = materialize(paths.unionByName(hop), "hops")  # else the plan doubles with each hop
    return paths


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The `branches` best root-to-leaf paths of each tree: (tree, branch, leaf, score, node, depth).

    A path's score is the sum of its messages' scores (null counts as 0); ties go to the smaller leaf.
    """
    paths = leaf_paths(messages)
    scores = messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("s")).dropDuplicates(["tree", "node"])
    total = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("s").alias("score"), F.max("up").alias("length"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = total.withColumn("branch", rank).where(F.col("branch") <= branches)
    return paths.join(chosen, ["tree", "leaf"]).select("tree", "branch", "leaf", "score", "node", (F.col("length") - F.col("up")).alias("depth"))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, node, parent, role, text, score) -> one chat per chosen path: (tree, branch, leaf, score, chat, loss_spans).

    loss_spans: begin and end in characters of `chat` of each assistant text, escapes included.  Null roles
    and texts count as empty.  Of rows repeated in (tree, node) one counts, the least by role and text.  A null tree is a tree of its own; rows with a null node are left out.
    """
    # As a struct, a null tree is a key like any other in the joins below.
    clean = messages.where("node is not null").withColumn("tree", F.struct("tree")).groupBy("tree", "node").agg(
        F.min("parent").alias("parent"), F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"), F.max("score").alias("score")
    )
    clean = materialize(clean.select("tree", "node", "parent", "m.role", "m.text", "score"), "messages")
    best = best_paths(clean, branches).join(clean.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    shown = best.withColumn("head", head).withColumn("body", escape(F.col("text")))
    turns = shown.groupBy("tree", "branch", "leaf", "score").agg(
        F.array_sort(F.collect_list(F.struct("depth", "head", "body", (F.col("role") == "assistant").alias("loss")))).alias("turns")
    )
    chat = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def add(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("turns", first, add, lambda acc: acc["spans"])
    return turns.select("tree.tree", "branch", "leaf", "score", chat.alias("chat"), spans.alias("loss_spans"))


def read_chat(chat: Column) -> Column:
    """The chat's messages, unescaped: array<struct<role, text>>."""
    parts = F.filter(F.split(chat, "<\\|im_start\\|>"), lambda p: p != "")
    head = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("all")))
    whole = lambda p: F.substr(p["all"], F.length(p["role"]) + F.lit(2), F.length(p["all"]) - F.length(p["role"]) - F.lit(1 + len(END)))
    return F.transform(head, lambda p: F.struct(unescape_role(p["role"]).alias("role"), unescape(whole(p)).alias("text")))


def linear_tree(rows: DataFrame, tree_col: str, order_col: str, role_col: str, text_col: str) -> DataFrame:
    """A table of turns as reply trees: each turn answers the one before it.  Rows of equal turn follow each
    other by role and text; null ids make one conversation, null turns come first.  A conversation is one row of the
    result, so it must fit a task; its turns are numbered there."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    turns = rows.select(F.col(tree_col).cast("long").alias("tree"), F.col(order_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    turns = turns.withColumn("node", F.row_number().over(order).cast("long"))
    return turns.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
