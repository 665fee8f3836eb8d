r"""Chat formatting of reply trees.

Messages form trees by parent. Iterative self-joins with doubling jumps (rounds grow with the logarithm of the depth) sum
each message's scores up to its root; leaves are ranked by that sum, and the same jumps then enumerate the root-to-leaf paths
of the chosen leaves only. Each becomes one text:

    <|turn:ROLE|>\nTEXT<|end|>\n

Inside a text every `<`, backslashes, `|` gets one backslash more, so that no control string can appear in it;
reading back takes one away. In a role, %, |, < and > are percent-encoded. loss_spans are the code points of
each assistant's text, end exclusive, as written (escaped). Null texts and roles count as empty. The messages of null
conv_id are one conversation like any other, with null conv_id in the result. Messages whose ancestors form a cycle have no
root: their conversation has one row more, without a text, whose problem says so; its other paths are as ever.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, stored

END = "<|end|>\n"
ROLE_ESCAPES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a.join(b, keys, how), but the null conv_id meets itself."""
    for k in keys:
        b = b.withColumnRenamed(k, f"of_{k}")
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) if k == "conv_id" else F.col(k) == F.col(f"of_{k}") for k in keys]
    return a.join(b, on, how).drop(*[f"of_{k}" for k in keys])


def chain(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: by turn, ties by role and text; score 0."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = messages.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
    return m.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def jumps(tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(the rounds' jumps, sums). Round k's jumps (conv_id, node_id, up) lead 2**k messages up; sums has (conv_id, node_id,
    total: of the scores from the message to its root, rootless: its ancestors form a cycle).

    A parent that isn't there makes a root. A round joins only messages that have so many ancestors; rounds end when none has,
    or none can: more than messages."""
    ids = tree.select("conv_id", "node_id", F.col("parent_id").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    there = ids.select("conv_id", F.col("node_id").alias("up"), F.lit(True).alias("there"))
    now = _joined(ids, there, ["conv_id", "up"], "left").select("conv_id", "node_id", F.when(F.col("there"), F.col("up")).alias("up"), "total")
    now = stored(now, "messages")
    rounds, most = [], None
    while (far := now.where("up is not null")).take(1):
        if most is None:
            most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        if 1 << len(rounds) > most:
            break
        rounds.append(far.select("conv_id", "node_id", "up"))
        above = now.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("more"))
        farther = _joined(far, above, ["conv_id", "up"]).select("conv_id", "node_id", F.col("up2").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        now = stored(now.where("up is null").unionAll(farther), "messages")
    return rounds, now.select("conv_id", "node_id", "total", F.col("up").isNotNull().alias("rootless"))


def paths(leaves: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(conv_id, leaf, node_id, back): the messages of the root-to-leaf path of each of leaves (conv_id, leaf), back steps above it.

    After k rounds a path has its last 2**k messages. Hot conversations are split: keys are messages."""
    found = leaves.select("conv_id", "leaf", F.col("leaf").alias("node_id"), F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(rounds):
        more = _joined(found, jump, ["conv_id", "node_id"]).select("conv_id", "leaf", F.col("up").alias("node_id"), (F.col("back") + (1 << k)).alias("back"))
        found = stored(found.unionAll(more), "paths")
    return found


def escaped(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def format_trees(tree: DataFrame, keep: int | None = 1) -> DataFrame:
    """tree (conv_id, node_id, parent_id, role, text, score) to conv_id, leaf, path_rank, path_score, formatted, loss_spans, problem.

    keep: paths of each conversation, best first (ties: smallest leaf); None keeps all. node_id is unique within
    a conversation. A null score counts as 0. problem is null but in the rows of messages without a root."""
    rounds, sums = jumps(tree)
    sums = stored(sums, "scored")
    ids = tree.select("conv_id", "node_id")
    parents = tree.where("parent_id is not null").select("conv_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = _joined(_joined(ids, parents, ["conv_id", "node_id"], "left_anti"), sums.where("not rootless"), ["conv_id", "node_id"])
    ranked = leaves.select("conv_id", F.col("node_id").alias("leaf"), F.col("total").alias("path_score"))
    ranked = ranked.withColumn("path_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf")))
    if keep is not None:
        ranked = ranked.where(F.col("path_rank") <= keep)
    ranked = stored(ranked, "leaves")
    steps = paths(ranked, rounds)
    role = F.coalesce("role", F.lit(""))
    for a, b in ROLE_ESCAPES:
        role = F.replace(role, F.lit(a), F.lit(b))
    body = tree.select("conv_id", "node_id", F.concat(F.lit("<|turn:"), role, F.lit("|>\n")).alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    rows = _joined(_joined(steps, ranked, ["conv_id", "leaf"]), body, ["conv_id", "node_id"])
    before = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("back"))
    whole = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("start", F.sum(whole.cast("long")).over(before) - F.length("body") - len(END))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(END)).alias("part"), "start", F.length("body").alias("n"), "learn")))
    out = rows.groupBy("conv_id", "leaf", "path_rank", "path_score").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["n"]).alias("end")))
    good = out.select("conv_id", "leaf", "path_rank", "path_score", F.array_join("turns.part", "").alias("formatted"), spans.alias("loss_spans"), F.lit(None).cast("string").alias("problem"))
    lost = sums.where("rootless").groupBy("conv_id").agg(F.count("*").alias("n"))
    empty = {c: F.lit(None).cast(good.schema[c].dataType) for c in good.columns[1:-1]}
    return good.unionByName(lost.select("conv_id", *[v.alias(c) for c, v in empty.items()], F.concat(F.col("n").cast("string"), F.lit(" messages without a root: their replies form a cycle")).alias("problem")))


_TURN = re.compile(r"<\|turn:([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)
_STUFFED = re.compile(r"<\\(\\*)\|")


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    out = []
    for role, text in _TURN.findall(formatted):
        for a, b in reversed(ROLE_ESCAPES):
            role = role.replace(b, a)
        out.append((role, _STUFFED.sub(r"<\1|", text)))
    return out


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts and their loss masks. Rows with a problem have no text and are left out."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in b.to_pylist():
            turns = parsed(x["formatted"])
            learnt = "".join(_STUFFED.sub(r"<\1|", x["formatted"][s["start"] : s["end"]]) for s in x["loss_spans"])
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((x["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(x["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return map_texts(formatted.where("formatted is not null").select("conv_id", "formatted", "loss_spans"), fn, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
