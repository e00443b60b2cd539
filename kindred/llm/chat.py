"""Operator 9: chat formatting of reply trees.

Messages form trees by their parents. Iterative self-joins enumerate the paths from the root to each leaf: every message
points to an ancestor and knows the sum of scores up to it, and a round joins it with that ancestor's own pointer, so
pointers double their reach and a tree of depth n takes log2(n) rounds. A message without replies ends a branch;
branches of a tree are ranked by score, and the chosen ones become one conversation each. Their messages come from the
same pointers, followed from the chosen leaves in as many rounds.

The template writes a message as ``### Role: text</turn>`` and a line break. Texts and roles have their backslashes
doubled and a backslash put before ``###`` and ``</turn>`` (roles: before every colon too), so the marks of a formatted
conversation are its own and every text reads back as it was. Spans under the loss mask are offsets in code points.

Cases: null texts and roles count as empty. A message whose parent is absent is a root; one that is its own ancestor,
or replies to such a message, belongs to no branch and is left out. Ties in score go to the smaller leaf id. Turns with equal numbers are ordered by
role and text, nulls first. Repeated message ids within a tree: the least row by role and text counts. An empty table
gives an empty result. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import materialize

END = "</turn>"
TRAINED = "assistant"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("###", "\\###").replace(END, "\\" + END)
    return out.replace(":", "\\:") if role else out


_escaped = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its trained texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"### {escape(role, role=True)}: ", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


_turn = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; raises ValueError where it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _turn.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def tree_of_turns(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before it (tree_id, message_id, parent_id, role, text, score)."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree_id"), "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"), "role", "text", F.lit(1.0).alias("score"))


def pointers(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree_id, message_id, score, depth) of every message that a root leads to, score being its path's sum, and for each
    round k (tree_id, message_id, up) of the messages that have an ancestor 2^k steps up."""
    own = messages.select("tree_id", "message_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = own.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"))
    held = own.join(known, own["tree_id"].eqNullSafe(known["t"]) & (own["parent_id"] == known["m"]), "left")
    state = materialize(held.select("tree_id", "message_id", F.col("m").alias("up"), "score", F.lit(1).alias("depth")))
    done, still, reach, largest = [state.filter("up IS NULL")], [], 1, None
    # ``up`` is the nearest ancestor not counted yet in score and depth.
    waiting = state.filter("up IS NOT NULL")
    while not waiting.isEmpty():
        still.append(waiting.select("tree_id", "message_id", "up"))
        if largest is None:
            largest = own.groupBy("tree_id").count().agg(F.max("count")).first()[0]
        if reach >= largest:  # longer than any path from a root, so only circles are left
            break
        ahead = reduce(DataFrame.union, [*done, waiting]).select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("up").alias("next"), F.col("score").alias("s"), F.col("depth").alias("d"))
        hop = waiting.join(ahead, waiting["tree_id"].eqNullSafe(ahead["t"]) & (waiting["up"] == ahead["m"]))
        state = materialize(hop.select("tree_id", "message_id", F.col("next").alias("up"), (F.col("score") + F.col("s")).alias("score"), (F.col("depth") + F.col("d")).alias("depth")))
        done.append(state.filter("up IS NULL"))
        waiting = state.filter("up IS NOT NULL")
        reach *= 2
    return reduce(DataFrame.union, done).drop("up"), still


def branches(messages: DataFrame, reached: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, score, depth) of every root-to-leaf path."""
    parents = messages.filter("parent_id IS NOT NULL").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    leaves = reached.join(parents, reached["tree_id"].eqNullSafe(parents["t"]) & (reached["message_id"] == parents["p"]), "left_anti")
    return leaves.withColumnRenamed("message_id", "leaf_id")


def ranked(paths: DataFrame, best: int | None) -> DataFrame:
    """The ``best`` branches of each tree by score (all where None), with their rank from 1."""
    order = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")
    out = paths.withColumn("branch", F.row_number().over(order))
    return out if best is None else out.filter(F.col("branch") <= best)


def members(chosen: DataFrame, still: list[DataFrame]) -> DataFrame:
    """(tree_id, leaf_id, depth, message_id) of the messages on the chosen branches; depth counts from the root.

    Round k follows the pointers 2^k steps up, so joins double what is known of a branch."""
    found = chosen.select("tree_id", "leaf_id", F.col("leaf_id").alias("message_id"), "depth")
    deepest, parts = chosen.agg(F.max("depth")).first()[0] or 0, [found]
    for k, up in enumerate(still):
        if 1 << k >= deepest:
            break
        hop = up.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "up")
        low = reduce(DataFrame.union, parts).filter(F.col("depth") > 1 << k)
        higher = low.join(hop, low["tree_id"].eqNullSafe(hop["t"]) & (low["message_id"] == hop["m"]))
        parts.append(materialize(higher.select("tree_id", "leaf_id", F.col("up").alias("message_id"), (F.col("depth") - (1 << k)).cast("int").alias("depth"))))
    return reduce(DataFrame.union, parts)


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """tree_id, leaf_id, branch, score, formatted and loss_spans of each chosen branch of each tree; written to a table, as
    batches of conversations are bounded by their bytes there.

    ``messages``: tree_id, message_id, parent_id, role, text, score."""
    content = messages.groupBy("tree_id", "message_id").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent_id", "score")).alias("r"))
    own = materialize(content.select("tree_id", "message_id", "r.parent_id", "r.role", "r.text", "r.score"))
    reached, still = pointers(own)
    chosen = materialize(ranked(branches(own, reached), best))
    on_path = members(chosen, still)
    text = own.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), "role", "text")
    rows = on_path.join(text, on_path["tree_id"].eqNullSafe(text["t"]) & (on_path["message_id"] == text["m"]))
    # A conversation is one value of one row, so its messages meet in one task by the definition of the result.
    gathered = rows.groupBy("tree_id", "leaf_id").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    ids = chosen.select(F.col("tree_id").alias("t"), F.col("leaf_id").alias("l"), "branch", "score")
    whole = gathered.join(ids, gathered["tree_id"].eqNullSafe(ids["t"]) & (gathered["leaf_id"] == ids["l"])).select("tree_id", "leaf_id", "branch", "score", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [write([(t["role"], t["text"]) for t in turns]) for turns in b.column(4).to_pylist()]
            spans = pa.array([[{"start": x, "end": y} for x, y in s] for _, s in done], SPANS)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x for x, _ in done], pa.string()), spans], ["tree_id", "leaf_id", "branch", "score", "formatted", "loss_spans"])

    kind = messages.schema["tree_id"].dataType.simpleString()
    return materialize(whole.mapInArrow(run, f"tree_id {kind}, leaf_id {messages.schema['message_id'].dataType.simpleString()}, branch int, score double, formatted string, loss_spans array<struct<start:int,end:int>>"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and what the formatted text and its spans give back: turns, trained text, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
