"""A join that spreads the rows of very frequent keys over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of the rows, so fewer keys than 1 / HOT are; the rows of each go to SALTS tasks.
HOT, SALTS = 1 / 2000, 64


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, with more underscores where one is taken (names compare as Spark's do)."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``left`` joined by ``key`` to ``right``, which has one row per key and in ``count`` the number of rows of ``left`` with that key.

    The rows of hot keys are dealt out by a salt, and their rows of ``right`` are repeated for each salt. Fewer than 1 / ``HOT`` keys can be hot: these are broadcast.
    ``right`` is read three times, so it should be a written table. how: 'inner' or 'left'.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    salt, hot = fresh([*left.columns, *right.columns], "salt", "hot")
    is_hot = F.col(count) > int(total * HOT) + 1
    keys = right.where(is_hot).select(key, F.lit(True).alias(hot))
    dealt = left.join(F.broadcast(keys), key, "left")
    dealt = dealt.withColumn(salt, F.when(F.col(hot), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)).drop(hot)
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn(salt, F.explode(every)).hint("merge"), [key, salt], how).drop(salt)
