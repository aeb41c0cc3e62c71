import random

import pytest
from pyspark.sql import functions as F

from samewise.llm import urls as U
from samewise.llm.q_urls import OP7_SQL, RULES, op7_url_filter
from tests.compare import compare


def test_parse_and_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://x.net/": ("x.net", "/", "net/", "block"),
        "https://net/x": ("net", "/x", "net/", "block"), "https://x.net": ("x.net", "", None, None), "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://example.com/de/?x": ("example.com", "/de/", "example.com/de/", "block"), "http://m.example.com/de": ("m.example.com", "/de", None, None),
        "ftp://é.org/fr/://y": ("é.org", "/fr/://y", "org/fr/", "allow"), "no scheme/x": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "a://?x/y": ("", "", None, None), "http://h.org#/fr/": ("h.org", "", None, None),
    }
    host, path = U.host_path(F.col("u"))
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host.alias("h"), path.alias("p")).withColumn("m", U.match(F.col("h"), F.col("p"), RULES))
    for r in df.collect():
        assert (r.h, r.p, *((r.m.rule, r.m.verdict) if r.m else (None, None))) == urls[r.u], r.u


def brute(seeds, links):
    """Both propagations over a dict of seeds (good, bad) and a list of links, a link once per page."""
    out, into = {}, {}
    for s, d in links:
        out[s] = out.get(s, 0) + 1
        into[d] = into.get(d, 0) + 1
    t = {h: 0.15 * g for h, (g, _) in seeds.items()}
    x = {h: 0.15 * b for h, (_, b) in seeds.items()}
    for _ in range(100):
        nt, nx = ({h: 0.15 * v[i] for h, v in seeds.items()} for i in (0, 1))
        for s, d in links:
            nt[d] += 0.85 * t[s] / out[s]
            nx[s] += 0.85 * x[d] / into[d]
        t, x = nt, nx
    return t, x


def test_propagation(spark):
    rnd = random.Random(9)
    hosts = [f"h{i}.{'org' if i % 3 else 'net'}" for i in range(12)] + ["big.com"]
    pages, links, per = [], [], {}
    for i in range(150):
        h = rnd.choice(hosts)
        path = rnd.choice(["/fr/", "/", "/x"])
        to = {rnd.choice([*hosts, "only-linked.com"]) for _ in range(rnd.randint(0, 3))} if i % 2 else {"h0.net"}
        html = "".join(f"<a HREF='https://{x.upper()}/p?q'>" if j % 2 else f'<a href="//{x}">' for j, x in enumerate(to)) + '<a href="/rel">'
        pages.append((i, f"http://{h}{path}", html, "x"))
        links += [(h, x) for x in to if x != h]
        verdict = "block" if h.endswith("net") else "allow" if h.endswith("org") and path == "/fr/" else None
        per.setdefault(h, []).append((verdict == "allow", verdict == "block"))
    seeds = {h: tuple(sum(c) / len(v) for c in zip(*v, strict=True)) for h, v in per.items()}
    for _, d in links:
        seeds.setdefault(d, (0.0, 0.0))
    t, x = brute(seeds, links)
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    judged, scores = U.judge_urls(table, RULES)
    got = {r.host: (r.trust, r.distrust) for r in scores.collect()}
    assert set(got) == set(seeds)
    for h in seeds:
        assert got[h] == pytest.approx((t[h], x[h]), abs=0.01)
    blocked = {h for h in seeds if x[h] >= 0.075 and x[h] > t[h]}
    assert any(not h.endswith("net") for h in blocked)  # hosts that link to blocked ones
    for r in judged.collect():
        assert r.verdict == ({"net/": "block", "org/fr/": "allow"}[r.rule] if r.rule else "block" if r.host in blocked else "allow")


def test_query_against_sql_on_linked_pages(spark, tmp_path):
    """op7 itself over written pages whose hosts link to each other, with farms and chains."""
    rnd, pages = random.Random(4), []
    hosts = [f"h{i}.{rnd.choice(['net', 'org', 'com', 'com', 'example.com'])}" for i in range(60)]
    liked = rnd.sample(hosts, 8)
    for i in range(500):
        h = hosts[i % 60] if i % 5 else f"farm{i}.com"
        to = [rnd.choice(liked if rnd.random() < 0.4 else hosts) for _ in range(rnd.randint(0, 4))] if i % 5 else [rnd.choice([x for x in hosts if x.endswith("net")])] * 2
        pages.append((i if i % 50 else None, f"https://{h}{rnd.choice(['/fr/a', '/de/', '', '/x?y'])}", "".join(f'<a href="http://{x}/">x</a>' for x in to) or None, "clash"))
    pages += [(i, f"https://hub.com/{i}", '<a href="//h1.com">', "x") for i in range(300)] + [(1, None, "<a href=//hub.com>", "x"), (2, "no host", None, "x")] + pages[:3]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, "op7", op7_url_filter, OP7_SQL, str(tmp_path))
    got = op7_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and len({r.host for r in got if r.rule is None and r.verdict == "block"}) > 20
    assert len({r.host for r in got if r.rule is None and r.verdict == "allow"}) > 10


def test_iteration_ends_where_little_is_left(spark):
    """Mass that fades over many hosts and meets again is waited for."""
    pages = [(0, "http://org/fr/", "".join(f'<a href="http://m{i}.com/">' for i in range(3000)))] + [(i, f"http://m{i}.com/", '<a href="http://hub.com/">') for i in range(3000)]
    scores = {r.host: r for r in U.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES)[1].collect()}
    assert scores["hub.com"].trust == pytest.approx(0.15 * 0.85**2) and scores["m7.com"].trust == pytest.approx(0.15 * 0.85 / 3000)


def test_edge_cases(spark):
    rows = [(1, None, None), (None, "http://a.org/fr/", None), (2, "http://a.org/x", ""), (2, "http://a.org/x", ""), (3, "nothing", "<a href=http://b.net/>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged, scores = U.judge_urls(df, RULES)
    assert sorted(((r.page_id, r.host, r.verdict) for r in judged.collect()), key=str) == sorted([(1, "", "allow"), (None, "a.org", "allow"), (2, "a.org", "allow"), (2, "a.org", "allow"), (3, "", "allow")], key=str)
    assert [r.host for r in scores.collect()] == ["a.org"]
    assert U.judge_urls(df.where("false"), RULES)[0].count() == 0


def test_farms_of_any_size(spark):
    pages, honest = [], set()
    for m in (2, 10, 1000):
        bad = f"bad{m}.net"
        pages.append((0, f"http://{bad}/", ""))
        pages += [(m, f"http://farm{m}-{i}.com/x", f'<a href="http://{bad}/">') for i in range(m)]
        # an honest host with one such link among four, and one that farms link to
        pages.append((m, f"http://honest{m}.com/x", "".join(f'<a href="http://{x}/">' for x in (bad, "a.com", "b.com", "c.com"))))
        pages.append((m, f"http://farm{m}-0.com/y", f'<a href="http://liked{m}.com/"><a href="http://{bad}/">'))
        honest |= {f"honest{m}.com", f"liked{m}.com"}
        pages.append((m, f"http://liked{m}.com/x", ""))
        # a step further from the blocked host
        pages.append((m, f"http://outer{m}.com/x", f'<a href="http://farm{m}-1.com/">'))
    judged, scores = U.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES)
    for r in judged.collect():
        assert (r.verdict == "allow") == (r.host in honest), r.host
    led = {r.host: r.led for r in scores.collect()}
    for m in (2, 10, 1000):
        assert led[f"farm{m}-1.com"] == pytest.approx(0.85) and led[f"outer{m}.com"] == pytest.approx(0.85**2) and led[f"honest{m}.com"] == pytest.approx(0.85 / 4)
