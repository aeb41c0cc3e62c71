"""The trie of all conversations' prefixes, with totals of its subtrees by time-forward processing.

A node is a distinct sequence of first turns; all conversations that start with it are its members. Its identity is a 128-bit
sum of hashes of turns with their positions, so the identities of all prefixes of a conversation are running sums,
taken over ranges of the whole order, and a conversation of any length is dealt to many tasks.

Totals of subtrees (childless nodes, tokens saved) are passed to parents by time-forward processing: nodes are
sorted by reverse level order (externally, by Spark), every node takes what was sent to it from a priority queue, adds
its own and sends the sum on to its parent. The queue keeps `room` messages in memory and spills sorted runs.

Shards are pieces of the trie. A node of more than max(LIGHT, turns / HEAVIEST) conversations is heavy and a piece of its
own; since every turn of a conversation belongs to one node, there are at most HEAVIEST heavy nodes, a bound for what
is broadcast. What is left are subtrees of few conversations; these are cut again at every BAND-th level, so that a very
long conversation is many pieces. Pieces are dealt to tasks, which first work out totals within them; their roots'
totals, summed up by the node they go to, are then passed on across pieces in a tree of pieces (only those that have
pieces below them); last, these are run again with what came from outside.

Edge cases: rows with null conv_id are no conversation and left out; null roles and texts are empty; null turns come
first, and of equal turns the order is that of a digest of role and text; repeated rows are turns of their own; a
conversation without turns is a member of the root alone; very long texts are hashed once and not moved; other columns are
ignored; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.operators.order import running, spread
from samewise.sources.shared import materialize

LIGHT, HEAVIEST, BAND, ROOM = 64, 1 << 16, 1024, 1 << 18
_DEALS, _RUNS, _READ = 1009, 32, 1 << 12
_EMPTY = hashlib.sha256(b"").hexdigest()

Message = tuple[int, int, int, int]


class SpillingQueue:
    """Messages (level, node, leaves, saved), least (level, node) first, of which at most `room` are in memory; the
    others lie in sorted runs in temporary files that vanish with the task."""

    def __init__(self, room: int = ROOM) -> None:
        self.room, self.spilled = room, 0
        self._heap: list[Message] = []
        self._runs: list[tuple[Message, int, Iterator[Message]]] = []

    def push(self, level: int, node: int, leaves: int, saved: int) -> None:
        heapq.heappush(self._heap, (level, node, leaves, saved))
        if len(self._heap) > self.room:
            self._add(iter(sorted(self._heap)))
            self._heap = []
            if len(self._runs) > _RUNS:
                runs, self._runs = [heapq.merge([head], rest) for head, _, rest in self._runs], []
                self._add(heapq.merge(*runs))

    def _add(self, messages: Iterator[Message]) -> None:
        """Write sorted messages as a run."""
        file = tempfile.TemporaryFile()  # noqa: SIM115  closed by the reader
        block: list[Message] = []
        for m in messages:
            block.append(m)
            if len(block) == _READ:
                file.write(np.array(block, np.int64).tobytes())
                block = []
        file.write(np.array(block, np.int64).tobytes())
        file.seek(0)

        def read() -> Iterator[Message]:
            with file:
                while data := file.read(32 * _READ):
                    yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, 4).tolist())

        self.spilled += 1
        rest = read()
        heapq.heappush(self._runs, (next(rest), self.spilled, rest))

    def take(self, level: int, node: int) -> tuple[int, int]:
        """The sums of all messages to a node, which leave the queue."""
        leaves = saved = 0
        while True:
            spilled = bool(self._runs) and (not self._heap or self._runs[0][0] < self._heap[0])
            if not spilled and not self._heap:
                return leaves, saved
            top = self._runs[0][0] if spilled else self._heap[0]
            if top[:2] > (level, node):
                return leaves, saved
            if top[:2] < (level, node):
                raise RuntimeError(f"no node at level {-top[0]} for what was sent to {top[1]}")
            if spilled:
                _, n, rest = heapq.heappop(self._runs)
                if head := next(rest, None):
                    heapq.heappush(self._runs, (head, n, rest))
            else:
                heapq.heappop(self._heap)
            leaves, saved = leaves + top[2], saved + top[3]


def _forward(room: int):
    """Replaces own values by totals in rows sorted by reverse level order; the first six columns are depth, node,
    up_depth and up (null where nothing is sent), leaves and saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(room)
        for batch in batches:
            leaves, saved = [], []
            for depth, node, up_depth, up, own_leaves, own_saved in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                a, b = queue.take(-depth, node)
                leaves.append(own_leaves + a)
                saved.append(own_saved + b)
                if up is not None:
                    queue.push(-up_depth, up, leaves[-1], saved[-1])
            columns = [*batch.columns[:4], pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), *batch.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _passed(rows: DataFrame, room: int) -> DataFrame:
    """rows, already dealt so that a node and what it is sent from are in one task, with totals for own values."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    return rows.sortWithinPartitions(F.desc("depth"), "node").mapInArrow(_forward(room), schema)


def _identity(sums: list[Column], depth: Column) -> tuple[Column, Column]:
    """Two 64-bit numbers that name the prefix of that depth and those sums."""
    return F.xxhash64(depth, *sums), F.xxhash64(*reversed(sums), depth, F.lit(1))


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv, depth, a, b, pa, pb, bytes): the node and its parent of each turn of turns(conv, pos, digest, bytes)."""
    low = F.lit((1 << 32) - 1)
    x, y = F.xxhash64("digest", "pos"), F.xxhash64("pos", "digest", F.lit(1))
    own = [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32)]
    valued = turns.select("conv", (F.col("pos") + 1).alias("depth"), "bytes", *[v.alias(f"v{i}") for i, v in enumerate(own)])
    run = running(valued, [F.col("conv"), F.col("depth")], {f"s{i}": F.col(f"v{i}") for i in range(4)}, {f"s{i}": "conv" for i in range(4)})
    a, b = _identity([F.col(f"s{i}") + F.col(f"v{i}") for i in range(4)], F.col("depth"))
    pa_, pb = _identity([F.col(f"s{i}") for i in range(4)], F.col("depth") - 1)
    return run.select("conv", "depth", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb.alias("pb"), "bytes")


def _nodes(path: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: a, b, depth, node (its smallest member), n_convs, bytes, n_children, parent (node of its parent)."""
    found = path.groupBy("a", "b", "depth").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    ra, rb = _identity([F.lit(0).cast("long")] * 4, F.lit(0).cast("long"))
    none = F.lit(None).cast("long")
    root = members.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs")).where("n_convs > 0").select(ra.alias("a"), rb.alias("b"), F.lit(0).cast("long").alias("depth"), "node", "n_convs", F.lit(0).cast("long").alias("bytes"), none.alias("pa"), none.alias("pb"))
    nodes = materialize(found.union(root).withColumn("deal", F.pmod(F.xxhash64("a", "b"), F.lit(_DEALS))), "nodes")
    # children of one parent are dealt to many tasks where they meet it
    below = nodes.where("depth > 0").groupBy("pa", "pb", "deal").agg(F.count("*").alias("n"))
    ups = materialize(below.join(nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("node").alias("parent")), ["pa", "pb"]), "parents")
    counts = ups.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("n").alias("n_children"))
    with_counts = nodes.join(counts, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return with_counts.join(ups.select("pa", "pb", "deal", "parent"), ["pa", "pb", "deal"], "left").select("a", "b", "depth", "node", "n_convs", "bytes", "n_children", "parent")


def _pieces(nodes: DataFrame, path: DataFrame, members: DataFrame, light: int, band: int) -> DataFrame:
    """nodes with their piece of the trie (ca, cb: the node at its top) and is_top."""
    most = max(light, -(-path.count() // HEAVIEST))
    heavy = F.broadcast(nodes.where((F.col("n_convs") > most) & (F.col("depth") > 0)).select("a", "b"))  # at most HEAVIEST rows
    depths = path.join(heavy, ["a", "b"], "left_semi").groupBy("conv").agg(F.count("*").alias("heavy"))
    known = members.join(depths, "conv", "left").withColumn("heavy", F.coalesce("heavy", F.lit(0))).where("length > heavy")
    level = lambda depth: F.floor((depth - 1) / band).cast("long")
    bands = known.withColumn("band", F.explode(F.sequence(level(F.col("heavy") + 1), level(F.col("length")))))
    tops = bands.select("conv", "band", F.greatest(F.col("heavy") + 1, F.col("band") * band + 1).alias("depth"))
    cuts = tops.join(path.select("conv", "depth", F.col("a").alias("ca"), F.col("b").alias("cb")), ["conv", "depth"]).select(F.col("conv").alias("node"), "band", F.col("depth").alias("top"), "ca", "cb")
    placed = nodes.withColumn("band", level(F.col("depth"))).join(cuts, ["node", "band"], "left")
    inside = F.col("top") <= F.col("depth")  # null or beyond: a heavy node, or the root
    own = lambda c, mine: F.when(inside, F.col(c)).otherwise(F.col(mine)).alias(c)
    return placed.select(*nodes.columns, own("ca", "a"), own("cb", "b"), F.coalesce(F.col("top") >= F.col("depth"), F.lit(True)).alias("is_top"))


def _totals(pieced: DataFrame, room: int) -> DataFrame:
    """pieced with leaves and saved summed over subtrees."""
    keep = ["a", "b", "n_convs", "n_children", "parent", "ca", "cb", "is_top"]
    own = {"own_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "own_saved": (F.col("n_convs") - 1) * F.col("bytes")}
    sent = F.when(~F.col("is_top"), F.col("parent"))
    rows = pieced.withColumns(own).select("depth", "node", (F.col("depth") - 1).alias("up_depth"), sent.alias("up"), F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved"), *keep, "own_leaves", "own_saved")
    local = materialize(_passed(spread(rows, "ca", "cb"), room), "local")

    # across pieces: what their tops send, by the node it goes to and that node's piece
    tops = local.where("is_top and parent is not null").select("ca", "cb", "depth", "node", F.col("parent").alias("to"), (F.col("depth") - 1).alias("to_depth"), "leaves", "saved")
    targets = tops.select("to", "to_depth").distinct().join(local.select(F.col("node").alias("to"), F.col("depth").alias("to_depth"), F.col("ca").alias("ta"), F.col("cb").alias("tb")), ["to", "to_depth"])
    targets = materialize(targets, "targets")
    inner = materialize(targets.select(F.col("ta").alias("ca"), F.col("tb").alias("cb")).distinct(), "inner")
    mail = tops.join(inner, ["ca", "cb"], "left_anti").groupBy("to", "to_depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    mail = materialize(mail, "mail")
    inbox = mail.join(targets, ["to", "to_depth"]).groupBy(F.col("ta").alias("ca"), F.col("tb").alias("cb")).agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    heads = materialize(local.where("is_top").join(inner, ["ca", "cb"], "left_semi").select("ca", "cb", "depth", "node", "parent", "leaves", "saved"), "heads")
    above = targets.join(heads.select(F.col("ca").alias("ta"), F.col("cb").alias("tb"), F.col("depth").alias("up_depth"), F.col("node").alias("up")), ["ta", "tb"])
    linked = heads.join(inbox, ["ca", "cb"], "left").join(above.select(F.col("to").alias("parent"), (F.col("to_depth") + 1).alias("depth"), "up_depth", "up"), ["parent", "depth"], "left")
    more = lambda c: (F.col(c) + F.coalesce(f"in_{c}", F.lit(0))).alias(c)
    # the tree of pieces that have pieces below them: heavy nodes, and pieces of more than one band
    across = linked.select("depth", "node", "up_depth", "up", more("leaves"), more("saved"), "parent")
    final = materialize(_passed(across.repartition(1), room), "across")
    sent = final.where("parent is not null").select(F.col("parent").alias("to"), (F.col("depth") - 1).alias("to_depth"), "leaves", "saved")
    came = mail.union(sent).groupBy(F.col("to").alias("node"), F.col("to_depth").alias("depth")).agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))

    again = local.join(inner, ["ca", "cb"], "left_semi").join(came, ["node", "depth"], "left")
    own_and = lambda c: (F.col(f"own_{c}") + F.coalesce(f"in_{c}", F.lit(0))).alias(c)
    rerun = _passed(spread(again.select("depth", "node", "up_depth", "up", own_and("leaves"), own_and("saved"), *keep), "ca", "cb"), room)
    columns = ["a", "b", "depth", "node", "parent", "n_convs", "n_children", "leaves", "saved"]
    return local.join(inner, ["ca", "cb"], "left_anti").select(*columns).union(rerun.select(*columns))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, b, block, text) sorted by these: SHA-256 of each node's texts joined by commas, never held whole."""
    now, digest = None, hashlib.sha256()
    done: list[tuple] = []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k, _ in done], pa.int64()), "b": pa.array([k[1] for k, _ in done], pa.int64()), "sha": pa.array([s for _, s in done], pa.string())})

    for batch in batches:
        for a, b, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
            if (a, b) == now:
                digest.update(b",")
            else:
                if now:
                    done.append((now, digest.hexdigest()))
                now, digest = (a, b), hashlib.sha256()
            digest.update(text.encode())
        yield table()
        done = []
    if now:
        done = [(now, digest.hexdigest())]
        yield table()


def _ends(path: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (a, b, sha): nodes where conversations end, with the hash of these conversations' ids."""
    ra, rb = _identity([F.lit(0).cast("long")] * 4, F.lit(0).cast("long"))
    last = members.where("length > 0").select("conv", F.col("length").alias("depth")).join(path.select("conv", "depth", "a", "b"), ["conv", "depth"]).select("a", "b", "conv")
    ends = last.union(members.where("length = 0").select(ra, rb, "conv"))
    # ids of one block differ in 12 bits only, so a block holds 4096 of them at most
    blocks = ends.groupBy("a", "b", F.shiftright("conv", 12).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    return spread(blocks, "a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(_hashes, "a long, b long, sha string")


def trie(turns: DataFrame, members: DataFrame, light: int = LIGHT, band: int = BAND, room: int = ROOM) -> DataFrame:
    """Rows (node, depth, parent, n_convs, n_children, leaves, saved, ends_sha256), one per node.

    turns(conv, pos, digest, bytes) are the turns of all conversations, numbered from 0; members(conv, length) tells how
    many each has. node is the smallest member, parent the parent's node; saved sums up over the subtree each
    node's bytes times its members but one; ends_sha256 hashes the ids of those that end here.
    """
    path, members = materialize(prefixes(turns), "prefixes"), materialize(members, "members")
    nodes = materialize(_nodes(path, members), "trie")
    totals = _totals(_pieces(nodes, path, members, light, band), room)
    out = totals.join(_ends(path, members), ["a", "b"], "left")
    return out.select("node", "depth", "parent", "n_convs", "n_children", "leaves", "saved", F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"))


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows (conv, base, turn, digest, bytes) of conversations(conv_id, turn, role, text): what a turn's place needs."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, members) for trie(): each conversation c with the first h turns of conversation c - c % family in
    place of its own first h, h being crc32 of c in decimal, modulo `most`.

    A conversation's rows are ranked with its family's first, so every other one knows how many turns that has.
    """
    rows = materialize(numbered(conversations).withColumn("base", F.col("conv") - F.col("conv") % family), "turns")
    order = [F.col("base"), F.col("conv") != F.col("base"), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    first = F.col("conv") == F.col("base")
    ranked = running(rows, order, {"pos": F.lit(1), "n_base": F.when(first, 1).otherwise(0)}, {"pos": "conv", "n_base": "base"})
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h")
    ranked = ranked.select("conv", "base", "digest", "bytes", "pos", "n_base", h)
    counts = ranked.groupBy("conv", "base", "h").agg(F.count("*").alias("n"), F.max("n_base").alias("n_base"))
    counts = counts.withColumn("taken", F.least(F.col("h"), F.when(first, F.col("n")).otherwise(F.col("n_base"))))
    members = materialize(counts.select("conv", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "members")
    # where own turns of the family's first come at all, h of them precede
    shift = F.when(first, F.col("h")).otherwise(F.least("h", "n_base")) - F.col("h")
    own = ranked.where("pos >= h").select("conv", (F.col("pos") + shift).alias("pos"), "digest", "bytes")
    heads = ranked.where(first & (F.col("pos") < most)).select("base", "pos", "digest", "bytes")
    copied = heads.join(members.select("conv", "base", "taken"), "base").where("pos < taken").select("conv", "pos", "digest", "bytes")
    return own.union(copied), members.select("conv", "length")
