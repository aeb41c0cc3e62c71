"""Quality rules whose cutoffs are certified on labelled documents. DataFrame functions only.

Each rule is a share or rate cut into BINS steps. The rejection by all rules together is tested in one sequence
of steps that is fixed in advance: it takes the rules in order and each from its loosest cutoff to its tightest,
and a step rejects what any step up to it does. For every length stratum the labelled good documents that pass
the base rules are a holdout: a step is certified if the exact binomial tail P(Bin(n, RISK) <= k) is at most its
level, k being the number of good documents among n that it rejects. That tail grows with k, and k grows along
the sequence, so testing from the first step on and stopping at the first failure (fixed-sequence testing) needs
no correction along it; DELTA is divided by the number of strata (Bonferroni), so that with probability 1 - DELTA
no stratum loses more than RISK of its good texts. Copies of a text are no independent trials, so the holdout holds
every distinct text once, good if one of its copies is. Among certified steps the one with the best
(bad rejected - COST x good rejected) is taken, the first on ties. A stratum needs 162 distinct labelled good texts
without a false rejection; fewer certify nothing.

Edge cases: null text counts as empty (no words: base_failed); a label without document, or with null
quality, is ignored; of several labels of one document the highest counts; repeated documents are judged
each; nulls in other columns do not matter; a very long text takes memory in proportion to its words, in one row;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.text import SPACE, WORD, fresh, let, words
from samewise.sources.shared import materialize

BINS = 50
RISK, DELTA, COST = 0.025, 0.05, 10
#: Lower bounds of the length strata, in words; what is shorter than the first fails the base rules.
STRATA = (50, 200, 1000)
RULES = ("symbols", "upper", "dup_lines", "repeats", "word_length")
def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more; windows are compared by a 64-bit hash within one text.

    Positions are only looked at where some window occurs twice.
    """
    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0).cast("long")))


def _covered(hashes: Column) -> Column:
    """Words in the windows whose hash occurs twice or more."""

    def positions(s: Column) -> Column:
        def same(i: Column, h: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == h, F.lit(False))

        return F.transform(F.filter(s, lambda x, i: same(i - 1, x["h"]) | same(i + 1, x["h"])), lambda x: x["i"])

    return F.aggregate(
        F.sort_array(let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), positions)),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def features(text: Column) -> Column:
    """struct of counts (long) of one whole text, and its hash (mark)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.xxhash64(text).alias("mark"),
        ),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def _bins(f: Column) -> dict[str, Column]:
    def part(a: Column, b: Column, top: int = BINS) -> Column:
        return F.least(F.lit(BINS), F.coalesce(F.floor(F.try_divide(a * top, b)), F.lit(0))).cast("int")

    return {
        "symbols": part(f["n_symbols"], f["word_chars"]),
        "upper": part(f["n_upper"], f["word_chars"]),
        "dup_lines": part(f["lines"]["n"] - f["lines"]["distinct"], f["lines"]["n"]),
        "repeats": part(f["n_repeat_words"], f["n_words"]),
        "word_length": part(f["word_chars"], f["n_words"], 2),
    }


def _stratum(f: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, STRATA)), lambda b: f["n_words"] >= b))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, brought back by the recurrence; absolute error below 1e-12 for x >= 1."""
    y = x + 10.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    back = sum((F.log(x + float(i)) for i in range(10)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - back


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), 1 where k >= n p, where it is no use: the terms from k downwards, each got from the one before.

    Below n p the j-th of them is at most exp(-j^2 / 2k) of the first, so those beyond 10 sqrt(k) + 60 are left out:
    together they are far below the rounding of a double.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    rest = F.aggregate(
        F.sequence(F.lit(0), F.least(k, F.floor(10 * F.sqrt(k)) + 60).cast("int")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), first * rest))


def first_step(f: Column) -> Column:
    """The first step of the sequence that rejects a text, null if none does. Step i x BINS + j holds the rules before
    RULES[i] at cutoff 1 and that rule at BINS - j; a cutoff at b rejects what has b or more."""
    return F.least(*[F.when(b > 0, i * BINS + BINS - b) for i, b in enumerate(_bins(f).values())])


def cutoffs(step: int) -> dict[str, int]:
    """The cutoff bins by rule of a step."""
    at, j = divmod(step, BINS)
    return {**{rule: 1 for rule in RULES[:at]}, RULES[at]: BINS - j}


def certify(labelled: DataFrame, f: str = "f", good: str = "good", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """From rows with the features `f` and the boolean `good`: one row per stratum and step (at most strata x rules x
    BINS) with n, k, bad rejected, tail and whether it is certified. Rows of one text are one trial."""
    passed = labelled.where(~base_failed(F.col(f))).groupBy(F.col(f)["mark"]).agg(F.first(f).alias(f), F.max(good).alias(good))
    counts = passed.select(_stratum(F.col(f)).alias("stratum"), F.col(good).alias("good"), first_step(F.col(f)).alias("first")).groupBy("stratum", "first").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    spread = counts.select("stratum", "g", "b", "first", F.explode(F.sequence(F.lit(0), F.lit(len(RULES) * BINS - 1))).alias("step"))
    within = F.col("first") <= F.col("step")
    cells = spread.groupBy("stratum", "step").agg(F.sum("g").alias("n"), F.sum(F.when(within, F.col("g")).otherwise(0)).alias("k"), F.sum(F.when(within, F.col("b")).otherwise(0)).alias("bad"))
    return cells.withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk)).withColumn("certified", F.col("tail") <= delta / len(STRATA))


def choose(cells: DataFrame) -> dict[int, int]:
    """The best certified step by stratum; at most one entry per stratum reaches the driver."""
    gain = F.struct((F.col("bad") - COST * F.col("k")).alias("gain"), (-F.col("step")).alias("back"))
    best = cells.where("certified").groupBy("stratum").agg(F.max(gain).alias("best")).where("best.gain > 0")
    return {r.stratum: -r.best.back for r in best.collect()}


def rejected(f: Column, steps: dict[int, int]) -> Column:
    """The method's verdict: whether the chosen step of the text's stratum rejects it."""
    step = F.lit(None).cast("int")
    for stratum, chosen in sorted(steps.items()):
        step = F.when(_stratum(f) == stratum, chosen).otherwise(step)
    return F.coalesce(first_step(f) <= step, F.lit(False))


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))


def verdict(f: Column, steps: dict[int, int]) -> Column:
    """struct<f, base_failed, kept> of the features f, which should be a stored column."""
    base = base_failed(f)
    return F.struct(f.alias("f"), base.alias("base_failed"), (~base & ~rejected(f, steps)).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with one more column `verdict`: struct<f, base_failed, kept>, after fitting the cutoffs to labels.

    The name is changed if docs has it already; it is always the last column. docs is stored with its features
    once, for counting the texts costs far more than a copy of them: labels then meet counts, not texts, and
    the verdict reads a stored column.
    """
    name = fresh("verdict", docs.columns)
    stored = materialize(docs.withColumn(name, features(F.col("text"))), "features")
    labelled = materialize(stored.select("doc_id", F.col(name).alias("f")).join(_good(labels), "doc_id"), "labelled")
    return stored.withColumn(name, verdict(F.col(name), choose(certify(labelled))))
