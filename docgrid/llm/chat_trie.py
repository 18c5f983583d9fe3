"""Chat formatting as prefix trees.

Conversations are sorted by the hashes of their turns, so those that share initial turns stand together and the sorted
order is a depth-first walk of their prefix tree. Each partition cuts its sorted rows into sequences: one tree each, of
at most MAX_CHARS new characters and MAX_CONVERSATIONS conversations. In a sequence every turn that several of its
conversations share is emitted once. A node has the range of its characters, the position ids of that range (its first
position is the number of characters of its ancestors, so siblings restart at the same position), and the intervals of
the sequence its characters may attend to: those of its ancestors, besides its own up to the character. Loss intervals
cover assistant texts.

A tree that a third of all conversations share is therefore spread over many sequences and partitions, each of bounded
size; only the shared turns are repeated, once a sequence.

The template writes a turn as `### Role: text </turn>` and a line break. In roles and texts, backslash, `#` and `<` are
escaped by a backslash, so no text can hold a control string and unescaping gives back every text.

Defined results: null roles and texts are empty; turns are ordered by turn, role and text (nulls first); repeated rows
are turns of their own; a conversation longer than the limit is one sequence, whole; rows without conv_id belong to no
other row: each is a conversation with a null id, so they never gather in one task; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS = 65_536
MAX_CONVERSATIONS = 1_024
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: The role's end is the first unescaped separator, so its colons are escaped as well.
_ROLE = re.compile(r"[\\#<:]")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn by the template, and the range of its escaped text."""
    head = OPEN + _ROLE.sub(lambda m: "\\" + m[0], role) + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)


def parse_turn(formatted: str) -> tuple[str, str]:
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


SEQUENCE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "position", "parent")]))),
    T.StructField("attends", T.ArrayType(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))),
    T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("leaf", T.LongType())]))),
])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.schema([
    ("text", pa.string()),
    ("nodes", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "position", "parent")]))),
    ("attends", pa.list_(pa.list_(_SPAN))),
    ("loss", pa.list_(_SPAN)),
    ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int64())]))),
])


class Tree:
    """The sequence under construction."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.attends: list[list[dict]] = []
        self.loss: list[dict] = []
        self.conversations: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # (turn, node) from the root to the last leaf

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        del self.path[self.shared(turns) :]
        for turn in turns[len(self.path) :]:
            parent = self.path[-1][1] if self.path else -1
            text, a, b = format_turn(*turn)
            start = self.size
            above = [] if parent < 0 else [*self.attends[parent], {"start": self.nodes[parent]["start"], "end": self.nodes[parent]["end"]}]
            position = 0 if parent < 0 else self.nodes[parent]["position"] + self.nodes[parent]["end"] - self.nodes[parent]["start"]
            self.nodes.append({"start": start, "end": start + len(text), "position": position, "parent": parent})
            self.attends.append(above)
            if turn[0] == "assistant":
                self.loss.append({"start": start + a, "end": start + b})
            self.parts.append(text)
            self.size += len(text)
            self.path.append((turn, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "leaf": self.path[-1][1]})

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "attends": self.attends, "loss": self.loss, "conversations": self.conversations}


def sequences(turns: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Prefix-tree sequences of the turns (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    talks = turns.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    talks = talks.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), path.alias("path"))
    # The id splits what is equal in all turns, so a conversation that many repeat does not stay in one partition.
    ordered = talks.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def build(batches):
        tree = Tree()
        for batch in batches:
            ready = []
            for conv_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [(t["role"], t["text"]) for t in own]
                if tree.conversations:
                    n = tree.shared(own)
                    new = sum(len(r) + len(t) for r, t in own[n:])
                    if n == 0 or tree.size + new > max_chars or len(tree.conversations) >= MAX_CONVERSATIONS:
                        ready.append(tree.row())
                        tree = Tree()
                tree.add(conv_id, own)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)
        if tree.conversations:
            yield pa.RecordBatch.from_pylist([tree.row()], schema=_ARROW)

    return ordered.mapInArrow(build, SEQUENCE)


def read_back(seqs: DataFrame) -> DataFrame:
    """Per conversation, from its leaf's attention intervals alone: turns, digests, loss text and formatted length."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches):
        for batch in batches:
            rows = []
            for seq in batch.to_pylist():
                text, nodes = seq["text"], seq["nodes"]
                by_start = {n["start"]: (n["start"], n["end"]) for n in nodes}
                parsed = {s: parse_turn(text[s:e]) for s, e in by_start.values()}
                starts = sorted(by_start)
                masked, k = {}, 0
                for span in seq["loss"]:
                    while k + 1 < len(starts) and starts[k + 1] <= span["start"]:
                        k += 1
                    masked[starts[k]] = unescape(text[span["start"] : span["end"]])
                for talk in seq["conversations"]:
                    leaf = nodes[talk["leaf"]]
                    spans = [(s["start"], s["end"]) for s in seq["attends"][talk["leaf"]]] + [(leaf["start"], leaf["end"])]
                    whole, learnt = hashlib.sha256(), hashlib.sha256()
                    chars = 0
                    for s, _ in spans:
                        role, body = parsed[s]
                        whole.update(f"{role}\n{body}\n".encode())
                        if s in masked:
                            learnt.update(masked[s].encode())
                            chars += len(masked[s])
                    rows.append((talk["conv_id"], len(spans), whole.hexdigest(), chars, learnt.hexdigest(), sum(e - s for s, e in spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    return seqs.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts hold the template's own control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op6_chat_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one numbered -7 with control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return read_back(sequences(turns.unionByName(more)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, text AS t, length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS et, length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) AS er FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + er + 2 + et + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone"""
