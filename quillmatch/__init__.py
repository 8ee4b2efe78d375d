"""Fuzzy string matching and entity resolution on Spark DataFrames."""

from quillmatch.api import compute_pairwise_similarities, group_similar_strings, match_most_similar, match_strings
from quillmatch.config import MatchOptions
from quillmatch.operators.representatives import new_group_rep_by_completeness, new_group_rep_by_earliest_timestamp, new_group_rep_by_highest_weight
from quillmatch.session import MatchSession, NotFittedError, Strings

__all__ = [
    "MatchOptions",
    "MatchSession",
    "NotFittedError",
    "Strings",
    "compute_pairwise_similarities",
    "group_similar_strings",
    "match_most_similar",
    "match_strings",
    "new_group_rep_by_completeness",
    "new_group_rep_by_earliest_timestamp",
    "new_group_rep_by_highest_weight",
]
