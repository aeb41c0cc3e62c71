"""Chat formatting as prefix trees.

A turn is written as `### role:` and a new line, the text, `</turn>` and a new line. In roles and texts a
backslash goes before every backslash, `#` and `<` (in roles also before `:`), so nothing in them reads as
a mark and all of it can be taken back.

Conversations are sorted by the hashes of their turns; those that share initial turns are then neighbours,
and going through them in order is a depth-first walk of the tree of turns. A task writes packs: one text in
which every tree node (a turn after the turns before it) stands once, with its start and length, the
position id of its first token, the span of its text if it is trained on, and the intervals of the pack that
its tokens attend to besides themselves (its ancestors). Tokens are code points here; token i of a node has
position id `position` + i. A pack is closed at PACK_CHARS or PACK_CONVERSATIONS and a conversation that goes
on in the next one repeats its shared turns there, so neither a very common first turn nor a very common
conversation has to fit in one task. Sharing is decided on roles and texts, not on hashes.

Edge cases: null role and null text are empty; null conv_id is one conversation of its own; turns are ordered
by turn, role and text with nulls first, repeated turns are kept; other columns are ignored; a turn longer than a pack is
one pack's text whole, and a task holds one conversation in memory; an empty table gives no pack.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
PACK_CHARS, PACK_CONVERSATIONS = 1 << 20, 1 << 13
_END = "</turn>\n"
_ESCAPE, _ESCAPE_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
_BACK = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\.)*+)</turn>\n", re.S)

_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_NODE = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("loss", _SPAN), ("attends", pa.list_(_SPAN))])
_PACK = pa.schema([("text", pa.string()), ("nodes", pa.list_(_NODE)), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])
PACK = (
    "text string, nodes array<struct<parent:int,start:bigint,length:bigint,position:bigint,loss:struct<start:bigint,stop:bigint>,"
    "attends:array<struct<start:bigint,stop:bigint>>>>, conversations array<struct<conv_id:bigint,leaf:int>>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, str]:
    """What comes before the text of a turn, and the text; _END follows."""
    return f"### {_ESCAPE_ROLE.sub(r'\\\g<0>', role)}:\n", escape(text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Pack:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.turns: list[tuple[str, str]] = []  # of the conversation added last
        self.path: list[int] = []  # its nodes

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        for a, b in zip(self.turns, turns, strict=False):
            if a != b:
                break
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        n = self.shared(turns)
        self.path, self.turns = self.path[:n], turns
        for role, text in turns[n:]:
            head, body = render(role, text)
            parent = self.nodes[self.path[-1]] if self.path else None
            attends = []
            if parent:
                attends = [*parent["attends"]]
                if attends and attends[-1]["stop"] == parent["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "stop": parent["start"] + parent["length"]}
                else:
                    attends.append({"start": parent["start"], "stop": parent["start"] + parent["length"]})
            at = self.size + len(head)
            node = {
                "parent": self.path[-1] if self.path else None, "start": self.size, "length": len(head) + len(body) + len(_END),
                "position": parent["position"] + parent["length"] if parent else 0,
                "loss": {"start": at, "stop": at + len(body)} if role == TRAINED else None, "attends": attends,
            }
            self.parts += [head, body, _END]
            self.size += node["length"]
            self.path.append(len(self.nodes))
            self.nodes.append(node)
        self.leaves.append({"conv_id": conv_id, "leaf": self.path[-1]})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["".join(self.parts)]), pa.array([self.nodes], _PACK.field(1).type), pa.array([self.leaves], _PACK.field(2).type)], schema=_PACK)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = _Pack()
    for batch in batches:
        for i in range(batch.num_rows):
            conv_id = batch.column(0)[i].as_py()
            turns = [(t["role"], t["text"]) for t in batch.column(1)[i].as_py()]
            fresh = sum(len(text) for _, text in turns[pack.shared(turns) :])
            if pack.leaves and (pack.size + fresh > PACK_CHARS or len(pack.leaves) >= PACK_CONVERSATIONS):
                yield pack.batch()
                pack = _Pack()
            pack.add(conv_id, turns)
    if pack.leaves:
        yield pack.batch()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Packs, with the columns of PACK, from conversations(conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.aggregate("turns", F.lit("").cast("binary"), lambda a, t: F.concat(a, F.unhex(F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0"))))
    keyed = whole.select("conv_id", "turns", path.alias("path"))
    # conv_id deals copies of one conversation to several tasks
    ordered = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(_packs, PACK)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        for i in range(batch.num_rows):
            text, nodes, leaves = (batch.column(k)[i].as_py() for k in range(3))
            seen: dict[int, tuple] = {}
            for leaf in {x["leaf"] for x in leaves}:
                node = nodes[leaf]
                spans = [*node["attends"], {"start": node["start"], "stop": node["start"] + node["length"]}]
                formatted = "".join(text[s["start"] : s["stop"]] for s in spans)
                if len(formatted) != node["position"] + node["length"]:
                    raise ValueError("position ids and attention intervals of a pack differ")
                turns = turns_of(formatted)
                loss, at = [], leaf
                while at is not None:
                    if nodes[at]["loss"]:
                        loss.append(unescape(text[nodes[at]["loss"]["start"] : nodes[at]["loss"]["stop"]]))
                    at = nodes[at]["parent"]
                trained = "".join(reversed(loss))
                seen[leaf] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(trained), sha(trained), len(formatted))
            rows = [(x["conv_id"], *seen[x["leaf"]]) for x in leaves]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(packs: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its attention intervals and loss spans hold."""
    return packs.select("text", "nodes", "conversations").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
