"""Options of a match, checked when they are given."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column

# Defaults that results depend on: fixed values.
DEFAULT_NGRAM_SIZE = 3
DEFAULT_REGEX = r"[,-./]|\s"
DEFAULT_MAX_N_MATCHES = 20
DEFAULT_MIN_SIMILARITY = 0.8


@dataclass(frozen=True)
class MatchOptions:
    """What a match computes. ``number_of_processes`` and ``n_blocks`` are accepted for callers that state them; Spark deals out the work.

    topn_side: whether ``max_n_matches`` limits the matches of a left (master) or of a right (duplicates) row.
    tokenizer: a function from a normalised string column to an array of grams, instead of character n-grams.
    """

    ngram_size: int = DEFAULT_NGRAM_SIZE
    regex: str = DEFAULT_REGEX
    max_n_matches: int = DEFAULT_MAX_N_MATCHES
    min_similarity: float = DEFAULT_MIN_SIMILARITY
    number_of_processes: int | None = None
    ignore_case: bool = True
    normalize_to_ascii: bool = True
    ignore_index: bool = False
    include_zeroes: bool = True
    replace_na: bool = False
    group_rep: str = "centroid"
    force_symmetries: bool = True
    n_blocks: tuple[int, int] | None = None
    tfidf_matrix_dtype: str = "float64"
    topn_side: str = "left"
    tokenizer: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.group_rep not in ("first", "centroid"):
            raise ValueError("group_rep is 'first' or 'centroid'")
        if str(getattr(self.tfidf_matrix_dtype, "__name__", self.tfidf_matrix_dtype)) not in ("float32", "float64"):
            raise ValueError("tfidf_matrix_dtype is float32 or float64")
        if self.topn_side not in ("left", "right"):
            raise ValueError("topn_side is 'left' or 'right'")
        if self.ngram_size < 1 or self.max_n_matches < 1:
            raise ValueError("ngram_size and max_n_matches are 1 or more")
        if self.n_blocks is not None and not (isinstance(self.n_blocks, tuple) and len(self.n_blocks) == 2 and all(isinstance(n, int) and not isinstance(n, bool) and n >= 1 for n in self.n_blocks)):
            raise ValueError("n_blocks is None or a tuple of two integers of 1 or more")
        if self.ignore_index and self.replace_na:
            raise ValueError("replace_na needs the index columns that ignore_index leaves out")

    @property
    def weight_type(self) -> str:
        return "float" if "32" in str(getattr(self.tfidf_matrix_dtype, "__name__", self.tfidf_matrix_dtype)) else "double"

    @classmethod
    def names(cls) -> set[str]:
        return {f.name for f in fields(cls)}
