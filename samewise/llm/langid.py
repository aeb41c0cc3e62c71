"""Language identification by compression against per-language dictionaries.

Training takes a bounded sample of rows: per language the whole texts of SAMPLE_DOCS distinct ones, the least by a
hash of the text, those of at most SAMPLE_CHARS characters first. Every language is learned; beyond
MAX_LANGUAGES of them rows per language shrink so that all dictionaries together stay as large as those of
MAX_LANGUAGES (one row each at least). The sample, lower-cased and cut down to letters, is a zstandard
raw-content dictionary. Prediction takes whole texts: normalised alike, cut into frames of FRAME bytes, each
compressed against every dictionary; the language with the least total wins (the first by name on ties).
zstandard stores what it can hardly shorten as it is, so texts under LEAST bytes are told again until they have as many.
The margin is the share by which the next best is larger; texts whose margin is under MARGIN are rejected.
With one language the next best is compression without a dictionary.

Edge cases: null text, or text without a letter, is `und` with score 0, as is everything when nothing was
learned; rows with null lang or text are not learned from; other columns, doc_id among them, play no part;
repeated rows are learned once and predicted each, alike; very long texts are compressed frame by frame, and learned
only where a language has too few others; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.text import fresh
from samewise.sources.shared import materialize

SAMPLE_DOCS, SAMPLE_CHARS, MAX_LANGUAGES = 48, 8192, 256
LEVEL, FRAME, LEAST = 6, 1024, 64
MARGIN = 0.03
_NO_LETTER = regex.compile(r"[^\p{L}\p{M}]+")


def normalise(text: str | None) -> bytes:
    """Lower-cased letters, all else one space; empty if there is no letter."""
    plain = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    return plain.encode() if any(c.isalpha() for c in plain) else b""


def train(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language from labelled(text, lang). What reaches the driver is bounded by MAX_LANGUAGES x
    SAMPLE_DOCS texts, or one per language."""
    own = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), (F.length("text") > SAMPLE_CHARS).alias("long"), "text")
    n = max(MAX_LANGUAGES, own.agg(F.count_distinct("lang")).first()[0])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    # copies of a text are one before they are ranked; texts are only read for the hashes that were drawn
    drawn = own.groupBy("lang", "long", "h").agg(F.lit(1).alias("one")).withColumn("rank", rank).where(F.col("rank") <= max(1, SAMPLE_DOCS * MAX_LANGUAGES // n))
    drawn = materialize(drawn.select("lang", "h", "rank"), "drawn")
    texts = own.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))
    sample: dict[str, list[bytes]] = {}
    for r in texts.orderBy("lang", "rank").collect():
        sample.setdefault(r.lang, []).append(normalise(r.text))
    return {k: b" ".join(v) for k, v in sorted(sample.items()) if any(v)}


def frames_of(plain: bytes) -> list[bytes]:
    """What is compressed of a normalised text that is not empty."""
    if len(plain) < LEAST:
        return [b" %b " % b" ".join([plain] * -(-LEAST // (len(plain) + 1)))]
    return [plain[i : i + FRAME] for i in range(0, len(plain), FRAME)]


class Classifier:
    """Compressors made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.by_lang = {}
        for lang, content in sorted(dictionaries.items()):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.by_lang[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin."""
        plain = normalise(text)
        if not plain or not self.by_lang:
            return "und", 0.0
        frames = frames_of(plain)
        sizes = sorted((sum(len(c.compress(f)) for f in frames), lang) for lang, c in self.by_lang.items())
        other = sizes[1][0] if len(sizes) > 1 else sum(len(self.plain.compress(f)) for f in frames)
        return sizes[0][1], max(0.0, (other - sizes[0][0]) / other)


def predictor(spark, dictionaries: dict[str, bytes]):
    """A function from a text column to struct<lang_pred, margin>."""
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("lang_pred string, margin double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts], columns=["lang_pred", "margin"])

    return run.asNondeterministic()  # else a filter on the result would run it twice


def identify(docs: DataFrame, dictionaries: dict[str, bytes], name: str = "language") -> DataFrame:
    """docs with one more column, last: struct<lang_pred, margin>."""
    return docs.withColumn(fresh(name, docs.columns), predictor(docs.sparkSession, dictionaries)(F.col("text")))


def accepted(language: Column, margin: float = MARGIN) -> Column:
    return (language["lang_pred"] != "und") & (language["margin"] >= margin)
