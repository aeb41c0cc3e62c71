import re

from samewise.llm import decontam, quality, urls
from samewise.llm.q_urls import RULES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    labelled = docs.join(quality._good(labels), "doc_id").select(quality.features(docs.text).alias("f"), "good")
    host, path = urls.host_path(pages.url)
    parsed = pages.select(host.alias("host"), path.alias("path"), urls.link_hosts(pages.html).alias("links"))
    graph = urls._graph(parsed.withColumn("hit", urls.match(parsed.host, parsed.path, RULES)))
    for df in (quality.judge(docs, labels), quality.certify(labelled), decontam.leaks(docs, benchmark), urls.judge_urls(pages, RULES)[0], urls.propagate(*graph)):
        assert not re.search("Python|Pandas|Arrow|BatchEval|CartesianProduct|BroadcastNestedLoop", plan(df))


def test_only_needed_columns_are_read(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = re.findall(r"ReadSchema: struct<([^>]*)>", docs.select("doc_id", quality.features(docs.text).alias("f"))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert found and {x.split(":")[0] for x in found[0].split(",")} == {"doc_id", "text"}
    assert "source" not in plan(decontam.leaks(docs, benchmark))
