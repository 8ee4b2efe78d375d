"""Normalisation and grams of string columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmatch.config import MatchOptions


def _ascii(strings: pd.Series) -> pd.Series:
    return strings.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def to_ascii(c: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII: Spark has no built-in for it."""
    return F.pandas_udf(_ascii, "string")(c)


def plain(c: Column, options: MatchOptions, ascii_only: bool) -> Column:
    """Lower case, ASCII, and without what the expression matches, in this order. ``ascii_only``: the column is known to be ASCII, so everything stays in the JVM."""
    if options.ignore_case:
        c = F.lower(c)
    if options.normalize_to_ascii and not ascii_only:
        c = to_ascii(c)
    unicode = "" if options.normalize_to_ascii or "(?U)" in options.regex else "(?U)"  # Java's \s is ASCII only by itself
    return F.regexp_replace(c, F.lit(unicode + options.regex), F.lit("")) if options.regex else c


def normalized(df, column: str, options: MatchOptions, to: str):
    """``df`` with the normalised column ``to``. Only rows that have other characters than ASCII pass through Python."""
    c = F.col(f"`{column}`")
    if not options.normalize_to_ascii:
        return df.withColumn(to, plain(c, options, True))
    other = c.rlike(r"[^\x00-\x7F]")
    return df.where(~other | c.isNull()).withColumn(to, plain(c, options, True)).unionByName(df.where(other).withColumn(to, plain(c, options, False)))


def ngrams(c: Column, size: int) -> Column:
    """Overlapping character n-grams, repeated ones kept; none if the string is shorter than ``size``."""
    return F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, size))).otherwise(F.array().cast("array<string>"))


def grams(c: Column, options: MatchOptions) -> Column:
    return options.tokenizer(c) if options.tokenizer else ngrams(c, options.ngram_size)
