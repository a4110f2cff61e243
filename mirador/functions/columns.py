"""Reusable Column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mirador.functions import lookups as L


def round3(c: Column) -> Column:
    """Half-up rounding to 3 decimals, the same double in Spark and DuckDB."""
    return F.floor(c * 1000 + 0.5) / 1000


def js_trim(c: Column) -> Column:
    """Trim all leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    """Empty or whitespace-only strings count as missing."""
    return F.when(F.length(js_trim(c)) > 0, c)


def map_literal(mapping: dict) -> Column:
    """A fixed lookup table as one map literal expression (a single JVM call)."""
    def lit(v):
        return f"{v!r}D" if isinstance(v, float) else "'" + str(v).replace("'", "\\'") + "'"
    return F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in mapping.items()) + ")")


def format_score(fmt: Column) -> Column:
    """Structure score of one resource format (lower + trim lookup)."""
    return F.coalesce(F.try_element_at(map_literal(L.FORMAT_SCORES), F.lower(F.trim(fmt))),
                      F.lit(L.DEFAULT_FORMAT_SCORE))


def format_key(fmt: Column) -> Column:
    """Distribution key of a format: empty or null means unknown, then upper case."""
    return F.upper(F.coalesce(F.when(fmt != "", fmt), F.lit("unknown")))


def status_score(status: Column) -> Column:
    """Accessibility score of one HTTP status (null = network error = 0)."""
    return (F.when((status >= 200) & (status < 300), F.lit(L.STATUS_OK_SCORE))
            .when(status.isin(*L.STATUS_REDIRECTS), F.lit(L.STATUS_REDIRECT_SCORE))
            .when(status == 403, F.lit(L.STATUS_FORBIDDEN_SCORE))
            .when(status >= 500, F.lit(L.STATUS_SERVER_ERROR_SCORE))
            .otherwise(F.lit(0.0)))


def score_level(score: Column) -> Column:
    expr = F.lit(L.LOWEST_LEVEL)
    for name, threshold in reversed(L.SCORE_LEVELS):
        expr = F.when(score >= threshold, F.lit(name)).otherwise(expr)
    return expr


def fold_accents(c: Column) -> Column:
    """Lower-case and drop the accents of Latin letters."""
    return F.translate(F.lower(c), L.ACCENTED, L.UNACCENTED)


def normalize_text(c: Column, full_unicode: bool = False) -> Column:
    """Query normalisation: lower, trim, accents removed.

    The default folds Latin letters with ``translate`` (JVM-side). With
    ``full_unicode`` every character is decomposed (NFD) and combining marks
    (U+0300..U+036F) are dropped, in an Arrow-batched pandas UDF."""
    if not full_unicode:
        return fold_accents(js_trim(c))
    return _strip_marks_udf()(F.lower(js_trim(c)))


def _strip_marks_udf():
    @F.pandas_udf("string")
    def strip_marks(col: pd.Series) -> pd.Series:
        import unicodedata

        def one(s):
            if s is None:
                return None
            return "".join(ch for ch in unicodedata.normalize("NFD", s) if not ("\u0300" <= ch <= "\u036f"))
        return col.map(one)
    return strip_marks


def fts_tokens(c: Column) -> Column:
    """Index tokens of one text: accents stripped, lower, split on non-letters."""
    # "[^a-z]+" matches exactly what TOKEN_IGNORE_PATTERN matches ('.' is not in
    # a-z) without the alternation, which halves the regex cost
    cleaned = F.trim(F.regexp_replace(fold_accents(F.coalesce(c, F.lit(""))), "[^a-z]+", " "))
    return F.array_remove(F.split(cleaned, " "), "")


def weighted_sum(pairs) -> Column:
    """Left-to-right sum of score * weight, starting from 0 (fixed float order)."""
    return reduce(lambda acc, p: acc + p[0] * F.lit(p[1]), pairs, F.lit(0.0))


def freshness_lambda(half_life_days: float = L.FRESHNESS_HALF_LIFE_DAYS) -> float:
    return math.log(2) / half_life_days


def thousandths(c: Column) -> Column:
    """A 3-decimal score as an exact integer number of thousandths."""
    return F.round(c * 1000).cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Floor division of non-negative integers, exact at any size below 2**53."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def avg3(c: Column) -> Column:
    """Aggregate: mean of 3-decimal scores, rounded half up to 3 decimals, exactly.

    Summing integer thousandths makes the result independent of the order in
    which partitions are merged (a float sum is not).
    """
    s = F.sum(thousandths(c))
    n = F.count(c)
    return int_div(s * 2 + n, n * 2) / 1000.0


def mean_exact(c: Column) -> Column:
    """Aggregate: mean of 3-decimal scores from an exact integer sum (unrounded)."""
    return F.sum(thousandths(c)) / (F.count(c) * 1000.0)


def epoch_micros(c: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    return F.unix_micros(c.cast("timestamp"))
