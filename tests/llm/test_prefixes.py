import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from samewise.llm import prefixes as P
from samewise.llm.q_prefixes import OP12_SQL, op12_prefix_trie
from tests.compare import compare

SCHEMA = "conv_id long, turn int, role string, text string, conv string, pos string, node int, depth int, base int"


def talks_of(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for c in rnd.sample(range(-40, 120), n):
        for t in range(rnd.choice([1, 2, 3, 5, 9, 12])):
            out.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "hé", None, "", "ok then", "more text"])))
    return out


def brute(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            talks[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in talks.items()}
    full = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        full[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(set)
    for seq in members:
        if seq:
            kids[seq[:-1]].add(seq)

    totals = {}
    for seq in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in kids[seq]) + (not kids[seq])
        own = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        totals[seq] = (leaves, own + sum(totals[k][1] for k in kids[seq]))
    out = []
    for seq, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if full[c] == seq)))
        out.append((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(kids[seq]), *totals[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("light", "band", "room"), [(P.LIGHT, P.BAND, P.ROOM), (3, 4, 5), (1, 1, 1), (8, 2, 3)])
def test_against_brute_force(spark, light, band, room):
    rows = talks_of(light) + [(1, None, "user", "first"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (1, 0, "assistant", "tie"), (None, 0, "user", "nobody")]
    rows += [(1000 + 5 * i, t, "user", f"same {t}") for i in range(30) for t in range(6)]  # copies of one conversation
    rows += [(2000, t, "user", "long " * (t % 3)) for t in range(40)]
    got = P.trie(*P.rebuilt(frame(spark, rows)), light, band, room).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_query_against_sql(spark, tmp_path):
    rows = talks_of(7, 90) + [(3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "user", "eit"), (None, 0, "user", "nobody")]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, "op12", op12_prefix_trie, OP12_SQL, str(tmp_path))
    assert sorted((tuple(r) for r in op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr) == brute(rows)


def test_empty_and_turnless(spark):
    assert P.trie(*P.rebuilt(frame(spark, [(1, 0, "user", "x")]).where("false"))).count() == 0
    # no conversation 5, and 7 keeps nothing of its own
    assert zlib.crc32(b"7") % 9 > 0
    got = P.trie(*P.rebuilt(frame(spark, [(7, 0, "user", "x")]))).collect()
    assert [tuple(r) for r in got] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_long_text_and_long_ids(spark):
    big = 1 << 60
    rows = [(big, 0, "user", "x" * 2_000_000), (big, 1, "user", "y"), (-big, 0, "user", "y")]
    assert sorted((tuple(r) for r in P.trie(*P.rebuilt(frame(spark, rows))).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("room", [1, 7, 1000])
def test_queue(room):
    rnd = random.Random(room)
    queue, want = P.SpillingQueue(room), defaultdict(lambda: [0, 0])
    for level in range(-40, 1):
        for node in range(31):
            assert queue.take(level, node) == tuple(want.pop((level, node), (0, 0)))
            for _ in range(rnd.randint(0, 5) if level < 0 else 0):
                to = (rnd.randint(level + 1, 0), rnd.randint(0, 30))
                queue.push(*to, 1, 1 << 40)
                want[to][0] += 1
                want[to][1] += 1 << 40
    assert not want
    assert room > 100 or queue.spilled


def test_queue_reports_a_missing_node():
    queue = P.SpillingQueue(2)
    for n in range(9):
        queue.push(-3, n, 1, 0)
    with pytest.raises(RuntimeError):
        queue.take(-2, 0)
