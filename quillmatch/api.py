"""One-call queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillmatch.session import MatchSession, Strings


def match_strings(master: Strings, duplicates: Strings | None = None, **options) -> DataFrame:
    """All pairs of similar strings within ``master``, or between it and ``duplicates``."""
    return MatchSession(master, duplicates, **options).fit().get_matches()


def match_most_similar(master: Strings, duplicates: Strings, **options) -> DataFrame:
    """For every duplicate the most similar master, or itself; each master is matched to one duplicate at most."""
    return MatchSession(master, duplicates, **(options | {"max_n_matches": 1})).fit().get_groups()


def group_similar_strings(strings: Strings, **options) -> DataFrame:
    """For every string the representative of its group of similar strings."""
    return MatchSession(strings, **options).fit().get_groups()


def compute_pairwise_similarities(one: Strings, two: Strings, **options) -> DataFrame:
    """The similarity of the strings at the same position of two columns."""
    return MatchSession(one, two, **options).dot()
