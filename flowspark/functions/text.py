"""Text and number formatting as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"[\s\x1c-\x1f]+"


def strip(col: Column) -> Column:
    """Remove any whitespace at both ends (``trim`` would only remove spaces)."""
    return F.regexp_replace(col, f"(?U)^{BLANKS}|{BLANKS}$", "")


def number(col: Column) -> Column:
    """A double in which null, NaN and unparseable values count as 0."""
    value = col.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def integer(col: Column) -> Column:
    """A counter: ``number`` cut towards zero."""
    return F.coalesce(number(col).try_cast("bigint"), F.lit(0).cast("bigint"))


def fixed(col: Column, decimals: int) -> Column:
    """Fixed-point text, rounding the exact binary value half to even.

    ``format_string`` rounds the shortest decimal half up (0.35 -> 0.4), which is not what
    C or Python printf do; a ``format_number`` pattern is.
    """
    pattern = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", col, F.lit(pattern))


def fill(template: str, value: Column) -> Column:
    """Put ``value`` at the ``{}`` of a template."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def format_time(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), F.lit("0s"))
        .when(seconds < 0.001, F.concat(fixed(seconds * 1_000_000, 0), F.lit("μs")))
        .when(seconds < 1, F.concat(fixed(seconds * 1000, 1), F.lit("ms")))
        .when(seconds < 60, F.concat(fixed(seconds, 2), F.lit("s")))
        .when(seconds < 3600, F.concat(fixed(seconds / 60, 1), F.lit("min")))
        .otherwise(F.concat(fixed(seconds / 3600, 1), F.lit("h")))
    )


def format_bytes(size: Column) -> Column:
    return (
        F.when(size.isNull() | F.isnan(size) | (size <= 0), F.lit("0 B"))
        .when(size < 1024, F.concat(fixed(size, 0), F.lit("B")))
        .when(size < 1024**2, F.concat(fixed(size / 1024, 1), F.lit("KB")))
        .when(size < 1024**3, F.concat(fixed(size / 1024**2, 1), F.lit("MB")))
        .otherwise(F.concat(fixed(size / 1024**3, 2), F.lit("GB")))
    )


def format_count(count: Column) -> Column:
    """Thousands separated by dots."""
    value = count.try_cast("bigint")
    return F.coalesce(F.translate(F.format_number(value, 0), ",", "."), F.lit("0"))


def format_rate(rate: Column) -> Column:
    return (
        F.when(rate.isNull() | F.isnan(rate) | (rate <= 0), F.lit("0"))
        .when(rate < 1000, fixed(rate, 1))
        .when(rate < 1_000_000, F.concat(fixed(rate / 1000, 1), F.lit("K")))
        .when(rate < 1_000_000_000, F.concat(fixed(rate / 1_000_000, 1), F.lit("M")))
        .otherwise(F.concat(fixed(rate / 1_000_000_000, 2), F.lit("G")))
    )


def format_value(col: Column, is_float: bool) -> Column:
    """A plain value: whole floats lose their fraction, others keep three decimals."""
    if not is_float:
        return col.cast("string")
    value = col.cast("double")
    return F.when(value == F.rint(value), fixed(value, 0)).otherwise(fixed(value, 3))


def clean_markup(col: Column) -> Column:
    """Drop citations, unwrap links, drop tags, collapse blanks: in that order."""
    text = F.regexp_replace(col, r"\(Citation:[^)]+\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = F.regexp_replace(text, f"(?U){BLANKS}", " ")
    return F.regexp_replace(text, "^ | $", "")


def lookup(mapping: dict, key: Column, default: str | None = None) -> Column:
    """Value of a small fixed mapping, or the default."""
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    found = table[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def letter_profile(col: Column) -> Column:
    """How often each letter a-z occurs, in either case: a small vector of any text, from one pass over its bytes; null counts as empty."""
    return _letter_counts(col)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _letter_counts(texts: pd.Series) -> pd.Series:
    def counts(text: str | None) -> np.ndarray:
        found = np.bincount(np.frombuffer((text or "").encode(), np.uint8), minlength=256)  # letters are single bytes of UTF-8
        return (found[65:91] + found[97:123]).astype(np.float32)

    return texts.map(counts)
