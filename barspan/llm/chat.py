"""Reply trees: root-to-leaf paths by self-joins, ranked by score, each formatted as one conversation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import materialize

# The template's own marks, and marks of other common templates that texts may hold.
TURN, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"\\|<(?=\|[^|<>\n]{1,40}\|>|/?s>|</?SYS>>)|\[(?=/?INST\])")


def escape(text: str) -> str:
    """Put a backslash before each control string and each backslash."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of assistant text in it (code points, marks left out)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


_MARKS = re.compile(r"\\.|<\|turn\|>|<\|text\|>|<\|end\|>", re.DOTALL)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted conversation, in one pass from mark to mark; a turn without its end is none."""
    out, role_at, text_at, role = [], None, None, ""
    for m in _MARKS.finditer(formatted):
        if m[0] == TURN:
            role_at, text_at = m.end(), None
        elif m[0] == SEP and role_at is not None:
            role, role_at, text_at = formatted[role_at : m.start()], None, m.end()
        elif m[0] == END and text_at is not None:
            out.append((unescape(role), unescape(formatted[text_at : m.start()])))
            text_at = None
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        made = [format_turns([(m["role"] or "", m["text"] or "") for m in r["messages"]]) for r in rows]
        yield pa.RecordBatch.from_pylist(
            [{**{k: r[k] for k in ("tree_id", "leaf_id", "branch_rank", "score")}, "n_turns": len(r["messages"]), "formatted": f, "loss_spans": [{"start": a, "stop": b} for a, b in s]} for r, (f, s) in zip(rows, made, strict=True)],
            schema=pa.schema([("tree_id", pa.int64()), ("leaf_id", pa.int64()), ("branch_rank", pa.int32()), ("score", pa.float64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]),
        )


FORMATTED = "tree_id long, leaf_id long, branch_rank int, score double, n_turns long, formatted string, loss_spans array<struct<start: long, stop: long>>"


def tree_paths(messages: DataFrame) -> DataFrame:
    """One row (tree_id, leaf_id, node_id, up) for each message on each root-to-leaf path; up counts steps above the leaf.

    Messages whose parent is null or isn't in the tree are roots. Each round joins the paths found so far with
    ancestors 1, 2, 4, ... steps up, and then these ancestors with themselves, so that a path of n messages takes
    log2(n) rounds. Only ids take part, never texts.
    Messages on a cycle, and what answers them, are on no path, as they lead to no root. They are known by an ancestor as
    many steps up as their tree has messages, and leave then, so that a tree of n messages gives n rows a leaf at most.
    """
    nodes = messages.select("tree_id", "node_id", "parent_id").dropDuplicates(["tree_id", "node_id"])
    ids = nodes.select("tree_id", F.col("node_id").alias("parent_id"))
    sizes = nodes.groupBy("tree_id").agg(F.count("*").alias("n"))
    answers = nodes.filter("parent_id is not null").join(ids, ["tree_id", "parent_id"], "left_semi").join(sizes, "tree_id")
    up = materialize(answers.select("tree_id", "node_id", F.col("parent_id").alias("over"), "n"), "chat-up")
    leaves = nodes.join(up.select("tree_id", F.col("over").alias("node_id")).distinct(), ["tree_id", "node_id"], "left_anti")
    paths = leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("up"))
    steps = 1
    while not up.isEmpty():
        endless = up.filter(F.col("n") <= steps)
        if not endless.isEmpty():
            paths = paths.join(endless.select("tree_id", F.col("node_id").alias("leaf_id")), ["tree_id", "leaf_id"], "left_anti")
            up = up.filter(F.col("n") > steps)
        higher = paths.join(up, ["tree_id", "node_id"]).select("tree_id", "leaf_id", F.col("over").alias("node_id"), (F.col("up") + steps).alias("up"))
        paths = materialize(paths.select("tree_id", "leaf_id", "node_id", "up").unionByName(higher), "chat-paths")
        next_up = up.select("tree_id", F.col("node_id").alias("over"), F.col("over").alias("top"))
        up = materialize(up.join(next_up, ["tree_id", "over"]).select("tree_id", "node_id", F.col("top").alias("over"), "n"), "chat-up")
        steps *= 2
    return paths


def reply_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the best branches of every reply tree, each as one conversation with its loss spans.

    messages: tree_id, node_id, parent_id (long), role, text (string), score (double); more columns are ignored.
    A branch's score is the mean of its messages' scores (null: 0); ties go to the smaller leaf_id. `branches` of them
    are kept by tree, which is what the operator is for; nothing else is dropped. Null texts and roles are empty ones.
    Of rows with the same tree_id and node_id the first by parent_id, role and text counts; null ids are on no path.
    An empty table gives an empty table. Texts join the chosen paths once, by message, so hot trees stay split;
    only the messages of one chosen path come together, since they are one output row.
    Result: tree_id, leaf_id, branch_rank, score, n_turns, formatted, loss_spans.
    """
    first = Window.partitionBy("tree_id", "node_id").orderBy("parent_id", "role", "text")
    one = messages.select("tree_id", "node_id", "parent_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    one = one.filter("tree_id is not null and node_id is not null").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    paths = tree_paths(one)
    scored = paths.join(one.select("tree_id", "node_id", "score"), ["tree_id", "node_id"])
    by_branch = scored.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score"))
    ranked = by_branch.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
    chosen = ranked.filter(F.col("branch_rank") <= branches)
    told = paths.join(chosen, ["tree_id", "leaf_id"]).join(one.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
    messages_of = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text")))
    whole = told.groupBy("tree_id", "leaf_id", "branch_rank", "score").agg(F.transform(messages_of, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))
    return whole.mapInArrow(_format, FORMATTED)


def chains(conversations: DataFrame) -> DataFrame:
    """Flat conversations as reply trees with one branch: each row answers the one before it by turn, role and text.

    Rows without conv_id belong to no conversation and are left out; rows that repeat are messages of their own. An empty
    table gives an empty one, and further columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("tree_id"), F.row_number().over(order).cast("long").alias("node_id"), "role", "text")
    return at.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(1.0))
