import random
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise.llm import simhash as S


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(), st.lists(st.sampled_from(["a", "B", "é", "The", "\n", " "]), max_size=40).map(" ".join)))
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) & (2**64 - 1) == slow_fingerprint(text)


def test_long_text_crosses_chunks():
    text = " ".join(f"w{i * i % 9973}" for i in range(70_000))
    assert S.fingerprint(text.encode()) & (2**64 - 1) == slow_fingerprint(text)


def brute_components(prints):
    fps = sorted(set(prints))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_links_small_and_crowded(spark):
    rnd = random.Random(5)
    centre, out = rnd.getrandbits(63), []
    for _ in range(120):  # a crowd of near copies: shared keys exceed the bucket
        f = centre
        for b in rnd.sample(range(64), rnd.randint(0, 2)):
            f ^= 1 << b
        out.append(f)
    for _ in range(60):  # chains at one to three bits
        f = rnd.getrandbits(64)
        for _ in range(4):
            out.append(f)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                f ^= 1 << b
    signed = [f - 2**64 if f >= 2**63 else f for f in out]
    ids = list(range(len(signed)))
    rnd.shuffle(ids)
    want_root = brute_components(signed)
    least = {}
    for i, f in zip(ids, signed, strict=True):
        least[want_root[f]] = min(i, least.get(want_root[f], 10**9))
    df = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    for bucket in (4, 32):
        got = {r.fp: r.component_id for r in S.components(df, bucket).collect()}
        assert got == {f: least[want_root[f]] for f in signed}


BASE = " ".join(f"word{i % 37}x{i}" for i in range(120))
ROWS = [
    (5, BASE, "en"), (3, BASE, "en"), (9, BASE.upper(), "en"), (7, "something else entirely here now", None),
    (None, BASE, "en"), (1, None, "en"), (2, "", None), (2, "", None), (4, "short text", "de"), (4, "another short", "de"), (None, "only nulls know this", None), (None, "only nulls know this", None),
]


def test_near_duplicates_edge_cases(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp string")
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(df).collect())
    prints = [(i, slow_fingerprint(t)) for i, t, _ in ROWS]
    least = {}
    for i, f in prints:
        if i is not None:
            least[f] = min(i, least.get(f, 10**9))
    assert got == Counter((i, f, least.get(f)) for i, f in prints)
    assert S.near_duplicates(df.where("false")).count() == 0


def test_keep_one(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, mark string")
    got = S.keep_one(df)
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(i for i, _ in rows) == Counter({3: 1, 7: 1, 1: 1, 4: 2, None: 1})
    assert (None, "only nulls know this") in rows
    assert S.keep_one(df.where("false")).count() == 0
