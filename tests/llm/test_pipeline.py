import re
from collections import defaultdict

import corpus_pipeline as C
from samewise.llm import langid, quality
from tests.llm.test_decontam import grams
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def clean_by_rules(text):
    """The base rules; with so few labels no cutoff is certified."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {p for v in at.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = docs.join(quality._good(spark.read.parquet(f"{SF}/labels.parquet")), "doc_id").select(quality.features(docs.text).alias("f"), "good")
    assert quality.choose(quality.certify(labelled)) == {}
    rows = [r for r in docs.collect() if clean_by_rules(r.text)]
    classifier = langid.Classifier(langid.train(spark.createDataFrame(rows, docs.schema)))
    rows = [r for r in rows if (p := classifier.predict(r.text))[0] != "und" and p[1] >= langid.MARGIN]
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    root, least = brute_components(prints.values()), {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    rows = [r for r in rows if least[root[prints[r.doc_id]]] == r.doc_id]
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(q and 5 * len(q & grams(r.text)) >= 4 * len(q) for q in items)]
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = brute_targets(sizes)
    got = C.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())


def test_stages_keep_columns_and_take_anything(spark, tmp_path):
    text = " ".join(f"Haus{i} der die und nicht mit word{i}" for i in range(12))
    rows = [(1, text, "de", "a", 1, True), (1, text, "de", "a", 1, True), (2, None, None, None, None, None), (None, text + " x", "en", None, 2, False), (3, "", "de", "a", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, verdict boolean").withColumn("mark", docs_lit()).withColumn("language", docs_lit())
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.where("false"), docs.where("doc_id = 1")):
        for name, stage in C.STAGES:
            out = stage(spark, table, str(tmp_path))
            if name != "mixing":
                assert out.columns == table.columns, name
            out.collect()
    kept = C.near_duplicates(spark, docs.where("doc_id = 1"), str(tmp_path))
    assert kept.count() == 1


def test_quality_stage_where_a_stratum_certifies(spark, tmp_path):
    """The certified rejection of stage 1 against plain Python: cutoffs by exact sums over distinct labelled texts."""
    from math import comb

    rows, labels = [], []
    for i in range(500):
        bad = i % 7 == 0
        words = [f"w{i}x{j}" for j in range(55)] + (["##%"] * (3 + i % 5) if bad else ["#"] * (i % 97 == 1))
        rows.append((i, " ".join(words) if i % 50 else f"short {i}", "en", "a", 1))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(600 + i, rows[7][1], "en", "a", 1) for i in range(150)] + [(800, None, None, None, None)]
    labels += [(600 + i, 1, 0) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    def step(text):
        w = text.split()
        symbols = sum(c in "#*$%&|<>" for c in text)
        bins = [min(50, 50 * symbols // sum(map(len, w))), 0, 0, 0, min(50, 2 * sum(map(len, w)) // len(w))]
        return min((n * 50 + 50 - b for n, b in enumerate(bins) if b), default=None)

    quality_of, texts = dict((i, q) for i, q, _ in labels), {}
    for i, t, *_ in rows:
        if i in quality_of and t and len(t.split()) >= 50:
            texts[t] = max(texts.get(t, 0), quality_of[i])
    good, bad = [step(t) for t, q in texts.items() if q], [step(t) for t, q in texts.items() if not q]
    n, best = len(good), (0, None)
    for s in range(250):
        k, gain = sum(g is not None and g <= s for g in good), sum(b is not None and b <= s for b in bad)
        if k < n * 0.025 and sum(comb(n, j) * 0.025**j * 0.975 ** (n - j) for j in range(k + 1)) <= 0.05 / 3 and gain - 10 * k > best[0]:
            best = (gain - 10 * k, s)
    assert best[1] is not None
    want = sorted(i for i, t, *_ in rows if t and len(t.split()) >= 50 and not (step(t) is not None and step(t) <= best[1]))
    got = C.quality_rules(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert 150 < len(want) < len([1 for r in rows if r[1] and len(r[1].split()) >= 50])


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("taken")
