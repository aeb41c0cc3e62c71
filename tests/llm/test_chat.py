import hashlib

from hypothesis import given
from hypothesis import strategies as st

from samewise.llm import chat as C

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", ""]), st.text(alphabet="\\#<>/turn: ok\né")), min_size=1, max_size=5)


@given(TURNS)
def test_round_trip(turns):
    assert C.turns_of("".join("".join(C.render(r, t)) + "</turn>\n" for r, t in turns)) == turns


@given(st.lists(TURNS, min_size=1, max_size=6))
def test_pack(conversations):
    conversations.sort()
    pack = C._Pack()
    for i, turns in enumerate(conversations):
        pack.add(i, turns)
    text, prefixes = "".join(pack.parts), {tuple(t[: k + 1]) for t in conversations for k in range(len(t))}
    assert len(pack.nodes) == len(prefixes)  # shared turns stand once
    for leaf, turns in zip(pack.leaves, conversations, strict=True):
        node = pack.nodes[leaf["leaf"]]
        whole = "".join(text[s["start"] : s["stop"]] for s in node["attends"]) + text[node["start"] : node["start"] + node["length"]]
        assert C.turns_of(whole) == turns and node["position"] + node["length"] == len(whole)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_edge_cases_and_small_packs(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (None, 0, None, None), (4, None, "assistant", "x"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (5, 0, "user", "z" * 5000)]
    rows += [(100 + i, j, "assistant" if j % 2 else "user", f"t{j}" if j < 3 else f"{i}") for i in range(50) for j in range(4)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, path string")
    for limit in (1 << 20, 200):
        monkeypatch.setattr(C, "PACK_CHARS", limit)
        packs = C.format_conversations(df)
        got = {r.conv_id: r for r in C.read_back(packs).collect()}
        by = {}
        for c, t, r, x in rows:
            by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    assert C.read_back(C.format_conversations(df.where("false"))).count() == 0
