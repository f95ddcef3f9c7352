"""Reply trees to formatted conversations with a reversible escape and a loss mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import written

ESCAPE = "\\"
HEAD, MIDDLE, TAIL = "<|turn|>", "<|says|>", "<|done|>"
#: Control strings of this template and of common others; none is left whole inside an escaped text.
CONTROLS = (
    HEAD, MIDDLE, TAIL, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|eot_id|>",
)
_MARKED = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_TURN = re.compile(f"{re.escape(HEAD)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(TAIL)}", re.DOTALL)


def escape(text: str) -> str:
    """The escape mark doubled, then one set after the first character of each control string, until none is whole."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    return _MARKED.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str | None, str | None]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: code-point spans (start, end) of the escaped texts to learn."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role or '')}{MIDDLE}", escape(text or "")
        if role == learned and body:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation; a null role or text comes back empty."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def masked(formatted: str, mask) -> str:
    """All text under the loss mask, unescaped span by span."""
    return "".join(unescape(formatted[a:b]) for a, b in mask)


def best_paths(
    nodes: DataFrame, tree: str, node: str, parent: str, score: str, per_tree: int = 1
) -> DataFrame:
    """Rows (tree, leaf, node, depth): the root-to-leaf paths of the ``per_tree`` best leaves of every tree.

    Self-joins double the step each time: after k of them a node knows its ancestor 2^k above and the score up to there,
    so a chain of n turns needs log2(n) of them. A path's score is the mean of its nodes', a null score being 0; ties go to
    the smaller leaf. The joins then run backwards from each chosen leaf and mark its ancestors. A tree takes part only in
    as many rounds as its own number of nodes asks for, and only nodes short of their root are joined: a long tree makes
    no work for the short ones.

    A node whose parent is null or absent is a root. Nodes on a cycle hang from no root and are left out.
    """
    rows = nodes.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up"), F.col(score).alias("score")
    )
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    sizes = rows.groupBy(F.col("tree").alias("sized")).agg(F.count("*").alias("size"))
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
    start = rows.join(known, same, "left").join(sizes, F.col("tree").eqNullSafe(F.col("sized"))).select(
        "tree", "node", F.col("n").alias("up"), F.col("n").isNotNull().cast("long").alias("depth"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), "size",
    )
    start = written(start, "reply-step")
    largest = start.agg(F.max("size")).first()[0] or 1
    steps, whole = [start], start.where("up is null and size <= 1")
    for k in range((largest - 1).bit_length()):
        step = steps[-1].where(F.col("size") > 2**k)
        far = step.select(*[F.col(c).alias(f"far_{c}") for c in ("tree", "node", "up", "depth", "total")])
        join = F.col("tree").eqNullSafe(F.col("far_tree")) & (F.col("up") == F.col("far_node"))
        above = step.where("up is not null").join(far, join)
        above = above.select(
            "tree", "node", F.col("far_up").alias("up"), (F.col("depth") + F.col("far_depth")).alias("depth"),
            (F.col("total") + F.col("far_total")).alias("total"), "size",
        )
        steps.append(written(step.where("up is null").unionByName(above), "reply-step"))
        whole = whole.unionByName(steps[-1].where((F.col("size") <= 2 ** (k + 1)) & F.col("up").isNull()))
    parents = start.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = whole.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node")
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_tree)
    chosen = written(chosen.select("tree", F.col("node").alias("leaf"), "node", "size"), "reply-leaves")
    found = None
    for k in range(len(steps) - 2, -1, -1):
        reached = chosen.where((F.col("size") > 2**k) & (F.col("size") <= 2 ** (k + 1)))
        reached = reached if found is None else found.unionByName(reached)
        hop = steps[k].where((F.col("size") > 2**k) & F.col("up").isNotNull())
        hop = hop.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = reached.join(hop, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        found = written(reached.unionByName(more.select("tree", "leaf", F.col("up").alias("node"), "size")), "reply-path")
    alone = chosen.where("size <= 1")
    found = alone if found is None else found.unionByName(alone)
    depths = whole.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    joined = found.join(depths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    return joined.select("tree", "leaf", "node", "depth")


def format_trees(
    nodes: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str = "score",
    per_tree: int = 1,
    learned: str = "assistant",
) -> DataFrame:
    """Rows (tree, leaf, formatted, loss_mask), one for each chosen path.

    Texts are escaped so that no control string of the template, nor of common other ones, stands in them; ``read_back``
    restores every turn. ``loss_mask`` lists the spans of the ``learned`` role's texts; an empty text has none. Null roles
    and texts are empty, a null score is 0, a null tree is a tree of its own, rows without a node are left out, and rows that
    repeat a node keep the first by role and text. Other columns are not read; an empty table gives no rows. One
    conversation is one row, so a single one must fit into memory.
    """
    alone = (
        nodes.where(F.col(node).isNotNull())
        .select(
            F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up"), F.col(role).alias("role"),
            F.col(text).alias("text"), F.col(score).alias("score"),
        )
        .groupBy("tree", "node")
        .agg(F.min(F.struct("role", "text", "up", "score")).alias("x"))
        .select("tree", "node", "x.*")
    )
    alone = written(alone, "replies")
    paths = best_paths(alone, "tree", "node", "up", "score", per_tree)
    said = alone.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    gathered = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    shape = T.StructType(
        [
            gathered.schema["tree"],
            gathered.schema["leaf"],
            T.StructField("formatted", T.StringType()),
            T.StructField("loss_mask", T.ArrayType(span)),
        ]
    )

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        spans = to_arrow_type(shape["loss_mask"].dataType)
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns], learned) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("tree"),
                    batch.column("leaf"),
                    pa.array([x for x, _ in done], pa.string()),
                    pa.array([[{"start": a, "end": b} for a, b in m] for _, m in done], spans),
                ],
                names=shape.names,
            )

    return gathered.mapInArrow(run, shape)


def replies_in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by (turn, role, text), nulls first."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    numbered = rows.select(conv, turn, role, text).withColumn("node", F.row_number().over(order).cast("long"))
    above: Column = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(
        F.col(conv).alias("tree"), "node", above.alias("parent"), F.col(role).alias("role"), F.col(text).alias("text"),
        F.lit(0.0).alias("score"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in each formatted conversation: turns, the text under the mask, and their digests."""
    shape = T.StructType(
        [
            T.StructField("conv_id", formatted.schema["tree"].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            rows = []
            for tree, text, mask in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss_mask")), strict=True):
                turns = read_back(text)
                loss = masked(text, [(m["start"], m["end"]) for m in mask])
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append(
                    (tree, len(turns), sha256(told.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text))
                )
            arrow = to_arrow_schema(shape)
            columns = list(zip(*rows, strict=True)) or [()] * len(shape.names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return formatted.select("tree", "formatted", "loss_mask").mapInArrow(run, shape)
