import random
import re

import pytest

from samewise.llm import decontam as D

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:  # as with a large benchmark: both sides are shuffled, the documents of a hash dealt out
        monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(D, "BROADCAST_CHARS", 0)
    rnd = random.Random(4)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, say(rnd.randint(5, 70))) for i in range(60)] + [(60, "too short item"), (61, None), (62, ""), (None, say(30)), (5, say(20)), (7, "W1, w2; w3! w4 w5? W6")]
    docs = [(i, say(rnd.randint(0, 300))) for i in range(80)]
    for i in range(150):  # whole, cut and edited items inside documents, some in many
        text = (items[rnd.randrange(60)][1] if i % 3 else items[3][1]).split()
        if i % 2:
            for _ in range(rnd.randint(1, 3)):
                text[rnd.randrange(len(text))] = "changed"
        cut = text[rnd.randint(0, 3) :] if i % 5 == 0 else text
        docs.append((200 + i, f"{say(rnd.randint(0, 400))} {' '.join(cut).upper()}. {say(5)}"))
    docs += [(900, None), (901, ""), (902, "w1 w2 w3 w4 w5 w6"), (None, items[0][1]), (0, items[1][1]), (0, items[1][1]), (903, say(20_000) + " " + items[2][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, text_hash int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in D.pairs(d, b).collect()}
    want = {}
    for i, t in docs:
        g = grams(t)
        for j, x in items:
            q = grams(x)
            n = len(q & g)
            if q and 5 * n >= 4 * len(q):
                want[i, j] = max(want.get((i, j), (0.0, 0, 0)), (n / len(q), len(q), n))
    assert got == {k: v[1:] for k, v in want.items()}
    kept = D.clean(d, b)
    assert kept.columns == d.columns
    dirty = {(i, t) for i, t in docs for _, x in items if grams(x) and 5 * len(grams(x) & grams(t)) >= 4 * len(grams(x))}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str(x) for x in docs if x not in dirty)
    assert D.pairs(d.where("false"), b).count() == 0 and D.pairs(d, b.where("false")).count() == 0
    assert D.clean(d, b.where("false")).count() == len(docs)
