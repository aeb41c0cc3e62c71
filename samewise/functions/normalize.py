"""Text normalisation and sanitising as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from samewise.errors import DataValidationError, SecurityError

#: White space as Python's \s has it; Java's leaves out U+001C to U+001F.
_WS = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = r"(?U)[^\w\s]"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

# Markup and script fragments that sanitising removes.
XSS_BASIC = (r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"on\w+\s*=")
XSS_MORE = (
    r"<iframe[^>]*>.*?</iframe>", r"<object[^>]*>.*?</object>", r"<embed[^>]*>.*?</embed>", r"<link[^>]*>", r"<meta[^>]*>", r"<style[^>]*>.*?</style>",
)
# Fragments of SQL and of paths that strict sanitising rejects.
SQL_PARTS = (r"\b(?:ALTER|CREATE|DELETE|DROP|EXEC(?:UTE)?|INSERT|SELECT|UNION|UPDATE)\b", r"[;|&$`]", r"'|\"|--|/\*|\*/")
PATH_PARTS = (r"\.\.", r"[/\\]+(?:etc|proc|sys|dev|tmp|var)[/\\]+", r"[/\\]+\.+[/\\]+")
# Detectors of secrets; the value is group 1 where there is one.
SECRETS = {
    "api_key": r"""api[_\-]?key["']?\s*[:=]\s*["']?([a-zA-Z0-9]{20,})""",
    "password": r"""password["']?\s*[:=]\s*["']?([^"'\s]{8,})""",
    "token": r"""token["']?\s*[:=]\s*["']?([a-zA-Z0-9]{20,})""",
    "secret": r"""secret["']?\s*[:=]\s*["']?([a-zA-Z0-9]{16,})""",
    "private_key": r"-----BEGIN [A-Z ]+PRIVATE KEY-----",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "aws_secret_key": r"aws[_\-]?secret[_\-]?access[_\-]?key",
}


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _WS, " "))


def preprocess(text: Column, lowercase: bool = True, strip_whitespace: bool = True, remove_punctuation: bool = False, pattern: str = PUNCTUATION) -> Column:
    """Null to empty, then white space, case and punctuation, in this order."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    if strip_whitespace:
        out = collapse(out)
    if lowercase:
        out = F.lower(out)
    if remove_punctuation:
        out = collapse(F.regexp_replace(out, pattern, ""))
    return out


def sorted_tokens(text: Column) -> Column:
    """Tokens between white space, sorted by code point and joined by one space."""
    return F.array_join(F.array_sort(tokens(text)), " ")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, _WS), "")


def sanitize_text(text: Column, max_length: int = 10_000, on_overflow: str = "raise") -> Column:
    """Drop control characters, collapse white space, remove script fragments. Longer texts raise, are cut
    (on_overflow='truncate') or become null ('null')."""
    if on_overflow == "raise":
        text = F.when(F.length(text) > max_length, F.raise_error(F.format_string("text longer than %d characters", F.lit(max_length)))).otherwise(text)
    elif on_overflow == "null":
        text = F.when(F.length(text) <= max_length, text)
    elif on_overflow == "truncate":
        text = F.substring(text, 1, max_length)
    else:
        raise DataValidationError("on_overflow is raise, truncate or null", on_overflow=on_overflow)
    out = collapse(F.regexp_replace(text, _CONTROL, ""))
    for pattern in XSS_BASIC:
        out = F.regexp_replace(out, f"(?is){pattern}", "")
    return out


def sanitize_columns(df: DataFrame, columns: list[str], **how) -> DataFrame:
    """sanitize_text on the listed columns; nulls stay."""
    return df.withColumns({c: sanitize_text(F.col(c), **how) for c in columns if c in df.columns})


def clean_for_excel(df: DataFrame) -> DataFrame:
    """String columns without control characters and with single spaces."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: collapse(F.regexp_replace(F.col(f"`{c}`"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")) for c in strings})


def sanitize_value(text: str, strict: bool = False, allow_html: bool = False, max_length: int = 10_000, on_overflow: str = "raise") -> str | None:
    """One string: length, control characters, NFKC, markup (escaped if allow_html), and in strict mode an error
    for anything that looks like SQL or a path climb, else such path parts removed. A longer text raises, is cut with a
    warning (on_overflow='truncate'; strict mode raises all the same) or becomes None ('null')."""
    if on_overflow not in ("raise", "truncate", "null"):
        raise DataValidationError("on_overflow is raise, truncate or null", on_overflow=on_overflow)
    if len(text) > max_length:
        if strict or on_overflow == "raise":
            raise SecurityError("text too long", length=len(text), limit=max_length)
        if on_overflow == "null":
            return None
        warnings.warn(f"text of {len(text)} characters cut to {max_length}", UserWarning, stacklevel=2)
        text = text[:max_length]
    text = unicodedata.normalize("NFKC", re.sub(_CONTROL, "", text))
    if allow_html:
        text = html.escape(text)
    else:
        for pattern in XSS_BASIC + XSS_MORE:
            text = re.sub(pattern, "", text, flags=re.I | re.S)
    if strict and (bad := next((p for p in SQL_PARTS if re.search(p, text, re.I)), None)):
        raise SecurityError("text looks like SQL", pattern=bad)
    for pattern in PATH_PARTS:
        if strict and re.search(pattern, text, re.I):
            raise SecurityError("text looks like a path climb", pattern=pattern)
        text = re.sub(pattern, "", text, flags=re.I)
    return " ".join(text.split())


def sanitize_secure(text: Column, **how) -> Column:
    """sanitize_value on a column (NFKC is not among Spark's functions); nulls stay."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sanitize_value(v, **how), na_action="ignore")

    return run(text)


def find_secrets(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows keys, type, value, nth, position, end: every secret that a detector finds in the text column, in order within
    its type; what the detector matched is text[position:end], counted in characters from 0."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(kind: str, pattern: str) -> Column:
        found = F.lit(f"(?i){pattern}")
        values, hits, between = F.regexp_extract_all(whole, found, F.lit(1 if "(" in pattern else 0)), F.regexp_extract_all(whole, found, F.lit(0)), F.split(whole, f"(?i){pattern}")
        before = lambda i: F.length(F.array_join(F.slice(between, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(hits, F.lit(1), i), ""))
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("type"), v.alias("value"), (i + 1).alias("nth"), before(i).alias("position"), (before(i) + F.length(F.get(hits, i))).alias("end")))

    found = [of(*x) for x in SECRETS.items()]
    return df.select(*keys, F.explode(F.flatten(F.array(*found))).alias("s")).select(*keys, "s.type", "s.value", "s.nth", "s.position", "s.end")


def extract_json(text: Column) -> Column:
    """The JSON in a reply: a fenced block, else from the first brace to the last, else all of it."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(F.trim(text))


def sanitize_names(columns: list[str]) -> list[str]:
    """Column names of word characters, - and . alone; white space to _, none at the ends, empty ones numbered."""
    out = []
    for i, c in enumerate(columns):
        name = re.sub(r"\s+", "_", re.sub(r"[^\w\s\-.]", "_", c)).strip("_")
        out.append(name or f"column_{i}")
    return out


def sanitize_filename(name: str) -> str:
    """The last path part without characters that file systems reserve; at most 255 characters; device names are marked."""
    base = re.split(r"[/\\]", name)[-1]
    base = re.sub(r'[<>:"|?*\x00-\x1f]', "_", base).strip(". ")[:255] or "unnamed"
    reserved = re.fullmatch(r"(?i)(con|prn|aux|nul|com\d|lpt\d)", base.split(".")[0])
    return f"safe_{base}" if reserved else base


def validate_api_key(key: str, pattern: str | None = None) -> bool:
    """10 to 256 characters without white space or control characters, and the pattern if given."""
    return isinstance(key, str) and 10 <= len(key) <= 256 and not re.search(r"[\s\x00-\x1f\x7f]", key) and (pattern is None or re.fullmatch(pattern, key) is not None)


def sanitize_config_value(value, kind: type, minimum=None, maximum=None, allowed: set | None = None):
    """value as kind within limits; strings are sanitised."""
    try:
        if kind is bool and isinstance(value, str):
            value = value.strip().lower() in ("true", "1", "yes", "on")
        value = sanitize_value(value, max_length=1000) if kind is str and isinstance(value, str) else kind(value)
    except (TypeError, ValueError) as e:
        raise SecurityError("config value has the wrong type", wanted=kind.__name__) from e
    if minimum is not None and value < minimum or maximum is not None and value > maximum or allowed is not None and value not in allowed:
        raise SecurityError("config value is not allowed", value=value)
    return value
