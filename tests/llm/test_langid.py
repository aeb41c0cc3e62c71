import zlib

import zstandard

from samewise.llm import langid as L
from samewise.llm.q_langid import op4_language_id

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_brute_force(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op4_language_id(spark, SF).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and len(rows[r.doc_id].text) >= 200]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.97 * len(held)
    # beginnings of held-out texts
    for chars, least in ((20, 0.9), (40, 0.97)):
        starts = [(L.normalise(rows[r.doc_id].text[:chars]), rows[r.doc_id].lang) for r in held]
        classifier = L.Classifier(L.train(spark.read.parquet(f"{SF}/documents.parquet").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")))
        assert sum(classifier.predict(t.decode())[0] == lang for t, lang in starts) >= least * len(starts), chars
    # one compressor per frame and language, made anew each time
    train = spark.read.parquet(f"{SF}/documents.parquet").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    dicts = L.train(train)
    for r in got[::9]:
        plain, best = L.normalise(rows[r.doc_id].text), []
        for lang, content in dicts.items():
            total = 0
            told = plain if len(plain) >= 64 else b" " + (plain + b" ") * (1 + (63 // (len(plain) + 1)))
            for i in range(0, len(told), 1024):
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=L.LEVEL)
                total += len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress(told[i : i + 1024]))
            best.append((total, lang))
        best.sort()
        assert r.lang_pred == best[0][1]
        assert abs(r.score - max(0.0, (best[1][0] - best[0][0]) / best[1][0])) < 1e-12


def test_edge_cases(spark):
    german, english = "der die das und nicht eine von zu mit sich auf " * 40, "the of and to in that is was for with as on " * 40
    rows = [(1, german, "de", 0), (2, english, "en", 0), (2, english, "en", 0), (3, None, "en", 1), (4, "123 $$ !!", None, 1), (5, "", "de", 2), (None, english, None, 3), (6, english * 500, "en", 4), (7, english * 500, "en", 4), (8, "9", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    dicts = L.train(df)
    assert sorted(dicts) == ["de", "en"] and len(dicts["en"]) == len(L.normalise(english)) + 1 + len(L.normalise(english * 500))
    out = L.identify(df, dicts)
    assert out.columns[:-1] == df.columns and out.columns[-1] == "language_"
    got = [(r.doc_id, r.language_.lang_pred) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "de"), (2, "en"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "en"), (7, "en"), (8, "und")], key=str)
    assert L.train(df.where("false")) == {}
    assert {r.language_.lang_pred for r in L.identify(df, {}).collect()} == {"und"}
    assert L.identify(df.where("false"), dicts).count() == 0
    assert [r.language_.lang_pred for r in L.identify(df.where("doc_id = 1"), {"de": dicts["de"]}).collect()] == ["de"]


def test_every_language_is_learned(spark):
    # more languages than MAX_LANGUAGES, each of its own words; the last has the fewest rows
    n, letters = L.MAX_LANGUAGES + 20, "abcdefghijklmnopqrstuvwxyz"
    word = lambda i, j: "".join(letters[(i * 7 + j * 11 + k * (i + 3)) % 26] + letters[(i // 26 + j + k * j) % 26] for k in range(4))
    text = lambda i: " ".join(word(i, j) for j in range(40))
    rows = [(i * 2 + c, text(i), f"l{i:03}") for i in range(n) for c in range(1 if i == n - 1 else 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = L.train(df)
    assert len(dicts) == n
    got = {r.doc_id: r.language.lang_pred for r in L.identify(df.where("doc_id % 60 = 0 or lang = 'l275'"), dicts).collect()}
    assert all(v == f"l{i // 2:03}" for i, v in got.items()) and got[(n - 1) * 2] == "l275"


def test_sample_is_of_distinct_rows(spark):
    # one text holds most rows, and one is longer than SAMPLE_CHARS
    texts = [f"alpha{chr(97 + i // 26)}{chr(97 + i % 26)} beta gamma" for i in range(L.SAMPLE_DOCS + 20)]
    rows = [(None, t, "x", i) for i, t in enumerate(texts)] + [(i, texts[3], "x", 0) for i in range(500)] + [(1, "long " * L.SAMPLE_CHARS, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    got = L.train(df)["x"]
    assert got.count(b"alpha") == L.SAMPLE_DOCS == len(set(got.split()) - {b"beta", b"gamma"}) and b"long" not in got
    assert L.train(df.repartition(7).withColumn("doc_id", df.doc_id + 5)) == {"x": got}  # other columns play no part
    assert L.train(df.where("text like 'long%'"))["x"] == L.normalise("long " * L.SAMPLE_CHARS)
