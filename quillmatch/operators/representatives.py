"""New representatives of given groups: by earliest timestamp, completeness or highest weight.

The representative is found by an aggregate per group, which is combined map-side, and joined back; ties go to the first row by ``order_by``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GroupColumn = str | int


def named(df: DataFrame, column: GroupColumn) -> str:
    """A column by its name or its place."""
    return df.columns[column] if isinstance(column, int) else column


def replaced(df: DataFrame, group: str, order: Sequence[Column], record_id: str, record_name: str | None, id_to: str, name_to: str) -> DataFrame:
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    value = F.struct(F.col(f"`{record_id}`").alias("id"), *([F.col(f"`{record_name}`").alias("name")] if record_name else []))
    reps = df.groupBy(F.col(f"`{group}`").alias("__g")).agg(F.min_by(value, key).alias("__r"))
    out = df.join(reps, F.col(f"`{group}`").eqNullSafe(F.col("__g")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__r.id").alias(id_to), *([F.col("__r.name").alias(name_to)] if record_name else []))


def is_date(text: str, **parser) -> bool:
    """Whether a string is a date in one of the formats that people write."""
    from dateutil.parser import ParserError, parse

    try:
        parse(text, **parser)
    except (ParserError, OverflowError, TypeError):
        return False
    return True


def parsed(df: DataFrame, c: Column, kind: T.DataType, parser: dict) -> Column:
    """Timestamps or numbers as they are, strings read; text that isn't a date is an error.

    Without parser options Spark's own formats are read in the JVM; strings in other formats go to the parser, as all do with options. Times without a zone are in the session's."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.NumericType)):
        return c
    if not isinstance(kind, T.StringType):
        raise ValueError("timestamps are date-like strings, timestamps, dates or numbers")
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")

    @F.pandas_udf("timestamp")
    def read(strings: pd.Series) -> pd.Series:
        from zoneinfo import ZoneInfo

        from dateutil.parser import ParserError, parse

        def one(s):
            if s is None:
                return None
            try:
                t = parse(s, **parser)
            except (ParserError, OverflowError) as e:
                raise ValueError(f"not a date: {s}") from e
            return t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))

        return pd.to_datetime(strings.map(one), utc=True)

    if parser:
        return read(c)
    own = F.when(c.rlike(r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.try_to_timestamp(c))
    return F.coalesce(own, read(F.when(own.isNull(), c)))


def new_group_rep_by_earliest_timestamp(df: DataFrame, group_col: GroupColumn, record_id_col: GroupColumn, timestamps: GroupColumn, record_name_col: GroupColumn | None = None, *, order_by: str, id_to: str = "group_rep_id", name_to: str = "group_rep", parserinfo=None, **parser) -> DataFrame:
    """Adds the id (and name) of the row with the earliest timestamp of each row's group; null timestamps come last."""
    if parserinfo is not None:
        parser = {"parserinfo": parserinfo, **parser}
    column = named(df, timestamps)
    time = parsed(df, F.col(f"`{column}`"), df.schema[column].dataType, parser)
    timed = df.withColumn("__time", time)
    out = replaced(timed, named(df, group_col), [F.col("__time").isNull(), F.col("__time"), F.col(f"`{order_by}`")], named(df, record_id_col), None if record_name_col is None else named(df, record_name_col), id_to, name_to)
    return out.drop("__time")


def new_group_rep_by_completeness(df: DataFrame, group_col: GroupColumn, record_id_col: GroupColumn, record_name_col: GroupColumn | None = None, tested_cols: Sequence[GroupColumn] | None = None, *, order_by: str, id_to: str = "group_rep_id", name_to: str = "group_rep") -> DataFrame:
    """The same for the row with the most filled columns (neither null nor empty)."""
    tested = [named(df, c) for c in (df.columns if tested_cols is None else tested_cols)]
    filled = sum((F.when(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == ""), 0).otherwise(1) for c in tested), F.lit(0))
    return replaced(df, named(df, group_col), [-filled, F.col(f"`{order_by}`")], named(df, record_id_col), None if record_name_col is None else named(df, record_name_col), id_to, name_to)


def new_group_rep_by_highest_weight(df: DataFrame, group_col: GroupColumn, record_id_col: GroupColumn, weights: GroupColumn, record_name_col: GroupColumn | None = None, *, order_by: str, id_to: str = "group_rep_id", name_to: str = "group_rep") -> DataFrame:
    """The same for the row with the highest weight; null weights and NaN come last."""
    weight = F.col(f"`{named(df, weights)}`").cast("double")
    weight = F.when(~F.isnan(weight), weight)
    return replaced(df, named(df, group_col), [weight.isNull(), -weight, F.col(f"`{order_by}`")], named(df, record_id_col), None if record_name_col is None else named(df, record_name_col), id_to, name_to)
