"""Operator 2, chat formatting of reply trees.

Iterative self-joins by doubling: after round k every message knows its ancestor 2^k
steps up, its depth and the summed score of the steps between, so a tree of depth d
takes log2(d) joins. Leaves are ranked by the score of their whole branch, the chosen
leaves' paths are read back along the same ancestors, and each is formatted.

One conversation is one output string, so its turns meet in one row by definition.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

# The public ChatML turn marks.
START, END = "<|im_start|>", "<|im_end|>"
FORMATTED = "formatted string, loss_spans array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """No "<|" is left: a bar after "<" and any backslashes gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Turns (role, text) -> the string, and the code-point spans that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, text = block.partition("\n")
        turns.append((unescape_role(role), unescape(text[: -len(END) - 1])))
    return turns


def _format(turns: pd.Series) -> pd.DataFrame:
    rows = [format_turns([(t["role"], t["text"]) for t in x]) for x in turns]
    return pd.DataFrame({"formatted": [f for f, _ in rows], "loss_spans": [[{"start": a, "end": b} for a, b in s] for _, s in rows]})


def format_paths(path_rows: DataFrame, key: list[str]) -> DataFrame:
    """path_rows(key..., pos, role, text) -> key..., formatted, loss_spans.

    Turns follow pos; ties follow role, then text. Null role or text is empty.
    """
    turn = F.struct("pos", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = path_rows.groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(*key, F.pandas_udf(_format, FORMATTED)("turns").alias("f")).select(*key, "f.formatted", "f.loss_spans")


def best_branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """messages(node, parent, score) -> path rows (leaf, rank, branch_score, pos, node).

    node is unique; parent is null (or unknown) at a root. score null counts as 0. A
    branch's score is the sum along root to leaf; of each tree the per_tree best leaves
    are chosen, ties to the least leaf. A cycle has no root and yields nothing. Rows that repeat
    a node are messages each, and branches through it come once for each; no message answers
    a null node. Empty in, empty out.
    """
    m = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = m.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    m = materialize(m.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("up"), "score"), "tree")
    # hop k: each node's ancestor 2^k up; total, steps and top grow with it
    state = m.select("node", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("steps"), F.col("node").alias("top"))
    hops, rounds = [m.select("node", "up").where("up is not null")], 0
    done, active = state.where("up is null"), state.where("up is not null")
    n = m.count()
    while 1 << rounds <= n:
        # only messages that have not reached a root go on; the rest is written once
        above = done.union(active).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("steps").alias("s2"), F.col("top").alias("top2"))
        state = materialize(active.join(above, "up").select("node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("top2").alias("top")), "tree")
        rounds += 1
        done, active = done.union(state.where("up is null")), state.where("up is not null")
        if active.isEmpty():
            break
        hops.append(active.select("node", "up"))
    # after as many steps as there are messages only a cycle is still active
    state = done
    leaves = state.where("up is null").join(m.select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    rank = F.row_number().over(Window.partitionBy("top").orderBy(F.col("total").desc(), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= per_tree)
    paths = chosen.select(F.col("node").alias("leaf"), "rank", F.col("total").alias("branch_score"), F.col("steps").alias("pos"), "node")
    for k in reversed(range(len(hops))):
        step = hops[k].select("node", F.col("up").alias("anc"))
        more = paths.join(step, "node").select("leaf", "rank", "branch_score", (F.col("pos") - (1 << k)).alias("pos"), F.col("anc").alias("node"))
        paths = materialize(paths.union(more), "paths")
    return paths


def format_trees(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """messages(node, parent, score, role, text) -> leaf, formatted, loss_spans of each chosen branch."""
    paths = best_branches(messages, per_tree)
    return format_paths(paths.join(messages.select("node", "role", "text"), "node"), ["leaf"])


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn -> reply trees of one branch each: every turn answers the one before.

    node is "conv_id:place"; repeated (conv_id, turn) rows stay, ordered by role, text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    name = lambda c: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), c.cast("string"))
    return rows.select(name(F.col("place")).alias("node"), F.when(F.col("place") > 1, name(F.col("place") - 1)).alias("parent"), F.lit(1.0).alias("score"), "role", "text", "conv_id")


FOUND = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What a reader of the output finds in it."""
    out = []
    for text, mask in zip(formatted, spans):
        turns = parse_turns(text)
        loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its id and what read_back() finds in its formatted text.

    Null and empty texts and roles are empty turns, very long texts are formatted whole.
    Turns tie by role, then text; repeated rows are turns each. A null conv_id is a
    conversation. Other columns are ignored, whatever their names. Empty in, empty out.
    """
    trees = materialize(linear_trees(conversations), "messages")
    formatted = format_trees(trees).withColumn("conv_id", F.regexp_extract("leaf", r"^(.*):\d+$", 1))
    out = formatted.select(F.expr("try_cast(conv_id as bigint)").alias("conv_id"), F.pandas_udf(read_back, FOUND)("formatted", "loss_spans").alias("r"))
    return out.select("conv_id", "r.*")
