import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise.llm import tokens as T
from samewise.llm.q_tokens import MODEL, op3_token_counts

PIECES = T.load_vocabulary(MODEL)
SMALL = {"\u2581": -2.0, "\u2581a": -1.1, "a": -2.3, "ab": -2.9, "b": -3.1, "abc": -4.7, "bc": -3.3, "c": -5.9, "\u2581ab": -3.7, "é": -6.1}


def library(pieces):
    """Unigram of the tokenizers library with the same pieces and byte fallback."""
    byte = [(f"<0x{i:02X}>", -1e6) for i in range(256)]
    # its unknown score counts from the worst score in the list; bytes are given the worst piece's
    worst = min(pieces.values())
    model = tokenizers.models.Unigram([("<unk>", worst), *pieces.items(), *[(b, worst) for b, _ in byte]], 0, True)
    return tokenizers.Tokenizer(model)


LIB, LIB_SMALL = library(PIECES), library(SMALL)


def expected(lib, text):
    return sum(len(lib.encode(T.MARK + w.decode()).ids) for w in (text or "").encode().split())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé d\n\u2581😀", max_size=60))
def test_small_vocabulary(text):
    assert T.PrefixTrie(T.Pieces(SMALL)).totals([text.encode().split()]) == [expected(LIB_SMALL, text)]


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_words == len(docs[r.doc_id].encode().split())
        assert r.n_tokens == expected(LIB, docs[r.doc_id])


def test_limits_do_not_change_counts(monkeypatch):
    words = [b"ab" * 300, b"abcabc", b"ab" * 300, b"\xc3\xa9a", b"abcabc", b"c" * 70]
    want = T.PrefixTrie(T.Pieces(SMALL)).totals([words])
    monkeypatch.setattr(T, "MAX_NODES", 3)
    monkeypatch.setattr(T, "MAX_DEPTH", 2)
    trie = T.PrefixTrie(T.Pieces(SMALL))
    assert [trie.totals([words]), trie.totals([words])] == [want, want]
    assert want[0] == sum(len(LIB_SMALL.encode(T.MARK + w.decode()).ids) for w in words)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "the house"), (4, "the house"), (4, "the house"), (5, "x" * 100_000)]
    got = sorted(((r.doc_id, r.n_words, r.n_tokens) for r in T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()), key=str)
    n = expected(LIB, "the house")
    assert got[:6] == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, n), (4, 2, n), (5, 1, expected(LIB, "x" * 100_000))] and got[6] == (None, 2, n)
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PIECES).count() == 0


def test_longest_last_piece_on_ties_and_extra_columns(spark):
    pieces = {"\u2581": -1.0, "\u2581a": -2.0, "a": -1.0, "ab": -3.0, "b": -2.0, "abb": -5.0}
    # \u2581 + abb, \u2581 + ab + b, \u2581a + b + b and \u2581 + a + b + b score alike; pieces 2, 3, 3 and 4
    df = spark.createDataFrame([(1, "abb", 7, "x")], "doc_id long, text string, n_tokens int, n_words string")
    assert [(r.doc_id, r.n_words, r.n_tokens) for r in T.count_tokens(df, pieces).collect()] == [(1, 1, 2)]
