"""Very long texts, and columns whose names clash with those that operators add."""

from pyspark.sql import functions as F

from samewise.llm import chat as C
from samewise.llm import decontam as D
from samewise.llm import simhash as S


def test_chat(spark):
    long = "x<#" * 700_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "ok"), (2, 0, "user", "hi"), (2, 1, "assistant", long)]
    talks = spark.createDataFrame([(*r, "a", "b", 3) for r in rows], "conv_id long, turn int, role string, text string, turns string, path string, leaf int")
    got = {r.conv_id: r for r in C.read_back(C.format_conversations(talks)).collect()}
    assert (got[1].loss_chars, got[2].loss_chars, got[1].n_turns) == (2, len(long), 2)
    assert got[1].formatted_chars == len(long) + 2 * 700_000 + 2 + 14 * 2 + len("userassistant")


def test_decontamination(spark):
    item = " ".join(f"item{i}" for i in range(20))
    filler = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, f"{filler} {item} {filler}"), (2, filler), (None, item), (3, None)]
    names = ["text_hash", "bad_id", "bad_hash", "item_id", "h", "row"]
    docs = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(7, item, 1)], "item_id long, text string, doc_id int").select("item_id", "text")
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert {(r.doc_id, r.item_id) for r in D.pairs(docs.select("doc_id", "text"), bench).collect()} == {(1, 7), (None, 7)}


def test_simhash(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    names = ["mark", "first_id", "first_mark", "copies", "fp", "deal", "root"]
    docs = spark.createDataFrame([(i, t, *range(7)) for i, t in ((5, long), (4, long), (9, "other words are here"), (4, long))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 9]
    assert sorted((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()) == [(4, 4), (4, 4), (5, 4), (9, 9)]
    assert docs.where(F.lit(False)).count() == 0
