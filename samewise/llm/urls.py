"""URL filters with trust and distrust propagated over links between hosts. DataFrame functions only.

Rules come first: a rule (host, path) fits its host and all subdomains if the url's path starts with the
rule's; the longest fitting rule decides, block before allow at equal length. Other urls take the verdict
of their host. Hosts are seeds: trusted by the share of their pages that rules allow, distrusted by the
share that they block. Links between different hosts are edges. Trust is a personalised PageRank from the
trusted seeds along edges, distrust the same from the blocked seeds along reversed edges; both are left
unnormalised, so that a host without links keeps (1 - DAMPING) times its seed, whatever the number of
hosts. A host is blocked if its distrust is at least THRESHOLD of a wholly blocked seed's own share and
greater than its trust.

That distrust is divided among all who link to a blocked host, so it fades as they get more. A host is also
judged by what does not depend on their number: led, its blocked share or DAMPING times the mean of led over
its out-links, if more; and known, its allowed share or DAMPING times the mean of known over its in-links, if
more. A host with led of at least THRESHOLD is blocked if its distrust exceeds its trust, or if none of its pages is
allowed by a rule and led exceeds known.

All four are iterated together until what further rounds could still change is at most TOLERANCE: for trust and
distrust of all seeds' mass, for the others of any host's value. A round shrinks that by DAMPING, so some 40 do.

Edge cases: a null url, or one without ://, has empty host and path, is in no graph and is allowed unless a
rule fits; null html has no links; pages without page_id and repeated rows are judged each (repeats count
in their host's shares); a link counts once per page and host; other columns are ignored; very long pages are searched
whole; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.text import ascii_lower
from samewise.sources.shared import materialize

DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 0.001
_CUT_EVERY, _SALTS = 4, 16


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest of rules (host, path, verdict) that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_hosts(html: Column) -> Column:
    """array<string> of the distinct hosts that absolute links of a page name."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda h: ascii_lower(h)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(judged, hosts): pages(page_id, url, html) with host, path, rule and verdict; hosts with trust and distrust."""
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), link_hosts(F.col("html")).alias("links")).withColumn("hit", match(F.col("host"), F.col("path"), rules))
    kept = materialize(parsed, "urls")
    scores = propagate(*_graph(kept))
    more = F.col("distrust") > F.col("trust")
    led = (F.col("led") >= THRESHOLD) & (more | (F.col("good") == 0) & (F.col("led") > F.col("known")))
    bad = scores.where((F.col("distrust") >= THRESHOLD * (1 - DAMPING)) & more | led).select("host", F.lit("block").alias("by_host"))
    # a host may have most pages, so its pages are dealt to several tasks
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(_SALTS)))
    found = salted.join(bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>"))), ["host", "salt"], "left")
    return found.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", "by_host", F.lit("allow")).alias("verdict")), scores


def _graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, steps): every host with its two seeds; every link in both directions from host a to host b, with the
    weights of what goes that way: trust and known along links, distrust and led against them."""
    own = parsed.where("host <> ''")
    shares = own.groupBy("host").agg(F.avg(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    raw = own.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    raw = materialize(raw, "links")
    out = raw.groupBy("src").agg(F.sum("n").alias("out"))
    into = raw.groupBy("dst").agg(F.sum("n").alias("into"))
    zero, forth, back = F.lit(0.0), F.col("n") / F.col("out"), F.col("n") / F.col("into")
    along = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), forth.alias("trust_w"), zero.alias("distrust_w"), zero.alias("led_w"), back.alias("known_w"))
    against = F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), zero.alias("trust_w"), back.alias("distrust_w"), forth.alias("led_w"), zero.alias("known_w"))
    steps = raw.join(out, "src").join(into, "dst").select(F.explode(F.array(along, against)).alias("x")).select("x.*")
    others = raw.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
    seeds = shares.union(others).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    return materialize(seeds, "seeds"), materialize(steps, "steps")


_SCORES = ("trust", "distrust", "led", "known")


def propagate(seeds: DataFrame, steps: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (host, good, bad, trust, distrust, led, known) from seeds(host, good, bad) over steps as of _graph."""
    seed = {"trust": (1 - damping) * F.col("good"), "distrust": (1 - damping) * F.col("bad"), "led": F.col("bad"), "known": F.col("good")}
    now = seeds.select("host", "good", "bad", *[v.alias(k) for k, v in seed.items()])
    if steps.isEmpty():
        return now
    mass = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    while True:
        for _ in range(_CUT_EVERY):
            came = steps.join(now, F.col("a") == F.col("host")).groupBy("b").agg(*[F.sum(F.col(k) * F.col(f"{k}_w")).alias(f"{k}_") for k in _SCORES])
            got = {k: damping * F.coalesce(f"{k}_", F.lit(0.0)) for k in _SCORES}
            new = {k: seed[k] + got[k] if k in ("trust", "distrust") else F.greatest(seed[k], got[k]) for k in _SCORES}
            joined = now.join(came, F.col("host") == F.col("b"), "left")
            now = joined.select("host", "good", "bad", *[v.alias(k) for k, v in new.items()], *[F.abs(v - F.col(k)).alias(f"{k}_change") for k, v in new.items()])
            changes, now = now, now.select("host", "good", "bad", *_SCORES)
        changes = materialize(changes, "rank")
        now = changes.select("host", "good", "bad", *_SCORES)
        c = changes.agg(F.sum("trust_change"), F.sum("distrust_change"), F.max("led_change"), F.max("known_change")).first()
        left = damping / (1 - damping)
        if c[0] * left <= tolerance * mass.good and c[1] * left <= tolerance * mass.bad and max(c[2], c[3]) * left <= tolerance:
            return now
