r"""Chat formatting as a prefix tree (operator 1).

Each turn is written as ``### <role>:\n<text>\n</turn>\n``. In role and text a backslash
goes before each backslash and # (and before : in a role), and </turn> becomes
<\/turn>, so that neither control string can stand in a text; taking one backslash from
before each character that has one gives the text back.

Conversations that share initial turns share nodes: a node is a turn with all turns before
it, named by a chained 128-bit hash. Nodes are emitted once, depth first (in the order of
their paths), in one sequence: a node has the place of its first token there, its position
id (the sum of the lengths above it), and as attention the stretches there that its
ancestors and itself cover (nodes in a row without a branch are one stretch). A token here is a code point of the formatted text; positions of a node's tokens
follow one another. The loss mask covers the text of assistant turns.

Distribution: conversations are sorted streams, so that a task holds one turn at a time
(and the branches above it); shared turns are aggregated before they are shuffled; the
depth-first sequence is a range partitioning of branches by path with a running sum, so a
first turn that a third of all conversations share is one row, and its subtree spreads over
tasks.

Defined cases: a null text or role is an empty one; turns are in the order of (turn, role,
text), a null turn first; repeated rows are turns of their own; rows without conv_id form
one conversation; an empty table gives no tree; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import lead_columns, shuffle_partitions, table, written

FOOT = "\n</turn>\n"
LEARNT = "assistant"
_BACK = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*):\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The turn as it is written, and from where to where the loss mask covers it (0, 0: nowhere)."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}:\n"
    body = escape(text)
    return head + body + FOOT, *((len(head), len(head) + len(body)) if role == LEARNT else (0, 0))


def parse(written_turn: str) -> tuple[str, str]:
    """role and text of a written turn."""
    head = _HEAD.match(written_turn)
    if not head or not written_turn.endswith(FOOT):
        raise ValueError(f"not a turn: {written_turn[:80]!r}")
    return unescape(head[1]), unescape(written_turn[head.end() : -len(FOOT)])


TURNS = "conv_id long, depth int, node binary, parent binary, position long, chars long, loss_from long, loss_to long, segment string"


def turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn: its conversation, depth from 0, node, the node before it, position id, and how it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = ()
        parent, depth, position = None, 0, 0
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != at:
                    at, parent, depth, position = conv, None, 0, 0
                seg, a, z = segment(role, text)
                node = hashlib.blake2b((parent or b"") + seg.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                out.append((conv, depth, node, parent, position, len(seg), a, z, seg))
                parent, depth, position = node, depth + 1, position + len(seg)
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in TURNS.split(", ")])

    rows = lead_columns(conversations, ["conv_id", "turn", "role", "text"]).select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    n = shuffle_partitions(conversations.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, TURNS)


def chains(steps: DataFrame) -> DataFrame:
    """node, head, path for steps(conv_id, depth, node, branch): the first node of each node's chain, and for heads the heads above and their own.

    A chain is a run of nodes without a branch: it starts at a root or below a node with
    several children. A path names chains, so a long conversation that shares little has a
    short one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = ()
        path: list[bytes] = []
        for b in batches:
            heads, paths = [], []
            for conv, node, branch in zip(*(b.column(c).to_pylist() for c in ("conv_id", "node", "branch")), strict=True):
                if conv != at:
                    at, path = conv, []
                if branch or not path:
                    path = [*path, node]
                    paths.append(path)
                else:
                    paths.append(None)
                heads.append(path[-1])
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(heads, pa.binary()), pa.array(paths, pa.list_(pa.binary()))], ["node", "head", "path"])

    n = shuffle_partitions(steps.sparkSession)
    each = steps.repartition(n, "conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, "node binary, head binary, path array<binary>")
    return each.groupBy("node").agg(F.first("head").alias("head"), F.first("path").alias("path"))


def prefix_tree(made: DataFrame) -> DataFrame:
    """node, parent, depth, place, position, chars, loss_from, loss_to, segment, attention for made, a written turns() table.

    place: where the node's first token stands in the depth-first sequence; attention: from
    and to (exclusive) of what the node's tokens see there, a stretch for each chain above
    and one from the head of its own chain to its end.
    """
    fields = ["parent", "depth", "position", "chars", "loss_from", "loss_to", "segment"]
    nodes = made.groupBy("node").agg(*(F.first(c).alias(c) for c in fields))
    n = shuffle_partitions(made.sparkSession)
    nodes = written(nodes)
    # Written, so that the join below has a shuffle on either side, which can be split where a parent has many children.
    branches = written(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).where("kids > 1"))
    told = made.select("conv_id", "depth", "node", "parent")
    below = told.where("parent is not null").join(branches, "parent", "left").select("conv_id", "depth", "node", F.col("kids").isNotNull().alias("branch"))
    roots = told.where("parent is null").select("conv_id", "depth", "node", F.lit(True).alias("branch"))
    nodes = written(nodes.join(chains(below.unionByName(roots)), "node"))
    sizes = nodes.groupBy("head").agg(F.sum("chars").alias("length"), F.min("position").alias("from"), F.first("path", True).alias("path"))
    ordered = written(sizes.repartitionByRange(n, "path").withColumn("part", F.spark_partition_id()))
    base, before = {}, 0
    for r in ordered.groupBy("part").agg(F.sum("length").alias("length")).orderBy("part").collect():  # a row for each partition
        base[r["part"]] = before
        before += r["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = None, 0
        for b in batches:
            places = []
            for p, length in zip(b.column("part").to_pylist(), b.column("length").to_pylist(), strict=True):
                if p != part:
                    part, place = p, base[p]
                places.append(place)
                place += length
            yield pa.RecordBatch.from_arrays([b.column("head"), pa.array(places, pa.int64())], ["head", "start"])

    order = ordered.select("head", "path", "part", "length").repartition(n, "part").sortWithinPartitions("part", "path")
    laid = written(ordered.drop("part").join(order.mapInArrow(run, "head binary, start long"), "head"))
    above = laid.select("head", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("up")).join(laid.select(F.col("head").alias("up"), "start", "length"), "up")
    seen = above.groupBy("head").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("length")).alias("past")))).alias("above"))
    j = nodes.drop("path").join(laid.drop("path", "length").join(seen, "head", "left"), "head")
    j = j.withColumn("place", F.col("start") + F.col("position") - F.col("from"))
    own = F.array(F.struct(F.col("start").alias("first"), (F.col("place") + F.col("chars")).alias("past")))
    return j.select("node", "parent", "depth", "place", *fields[2:], F.when(F.col("above").isNull(), own).otherwise(F.concat("above", own)).alias("attention"))


def read_back(made: DataFrame, tree: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: each conversation's path through the tree, parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = ()
        state = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done() -> tuple:
            return at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for b in batches:
            out = []
            for conv, seg, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if conv != at:
                    if state:
                        out.append(done())
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(seg)
                learnt = unescape(seg[a:z])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(seg)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(done(), kinds, strict=True)], names)

    n = shuffle_partitions(made.sparkSession)
    told = made.select("conv_id", "depth", "node").join(tree.select("node", "segment", "loss_from", "loss_to"), "node")
    return told.repartition(n, "conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their nodes, and the prefix tree."""
    made = written(turns(conversations))
    return made, prefix_tree(made)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = lead_columns(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"])
    made, tree = format_conversations(rows.unionByName(more))
    return read_back(made, written(tree))


#: What reading back must give, computed from the conversations themselves (formatted_chars by the template's lengths).
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS said FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, replace(replace(replace(said, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS e,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS r
  FROM c
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
       CAST(coalesce(sum(length(said)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(e) + 15) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
