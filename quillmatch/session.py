"""A match session: one or two string columns, options, and the match list that all results are read from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.config import MatchOptions
from quillmatch.functions.text import grams, normalized, plain
from quillmatch.operators import grouping, matching, vectors
from quillmatch.operators.positions import with_positions
from quillmatch.shared import written


class NotFittedError(Exception):
    """A result was asked for before fit()."""


@dataclass(frozen=True)
class Strings:
    """A string column with what identifies its rows.

    order_by: columns that order the rows; without, the order in which they are read. key: a column of unique longs that already is the position (nothing is sorted
    then). index: columns that stand for the row in outputs; without, the position does. ``name`` is the column's name in outputs (None: unnamed).
    """

    df: DataFrame
    column: str
    id: str | None = None
    index: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    key: str | None = None
    name: str | None = "*"

    @property
    def label(self) -> str | None:
        return (self.column if self.name == "*" else self.name) or None

    def rows(self, options: MatchOptions) -> DataFrame:
        """pos, string, form, id (if any) and index columns i0, i1, ..."""
        kind = self.df.schema[self.column].dataType
        if not isinstance(kind, T.StringType):
            raise TypeError(f"column {self.column} isn't a string column")
        columns = [F.col(f"`{self.column}`").alias("string")]
        columns += [F.col(f"`{self.id}`").alias("id")] if self.id else []
        columns += [F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(self.index)]
        if self.key:
            out = self.df.select(*columns, F.col(f"`{self.key}`").cast("long").alias("pos"))
        else:
            out = with_positions(self.df.select(*columns, *[F.col(f"`{c}`").alias(f"__o{k}") for k, c in enumerate(self.order_by)]), "pos", [f"__o{k}" for k in range(len(self.order_by))])
            out = out.drop(*[f"__o{k}" for k in range(len(self.order_by))])
        out = out.withColumn("string", F.coalesce("string", F.raise_error(F.lit(f"column {self.column} has a null string"))))
        out = normalized(out, "string", options, "form_text")
        # postings carry the form: a long one by its digest
        return out.withColumn("form", F.when(F.length("form_text") <= 40, F.col("form_text")).otherwise(F.md5("form_text")))

    def index_names(self) -> list[str]:
        return list(self.index) or ["index"]

    def index_columns(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.index))] or ["pos"]


def fitted(method):
    @wraps(method)
    def run(self, *args, **kwargs):
        if not self.is_build:
            raise NotFittedError("call fit() first")
        return method(self, *args, **kwargs)

    return run


class MatchSession:
    """Matches of ``master`` with itself, or with ``duplicates``. corpus: 'refit' learns weights from the data of each fit, 'frozen' keeps those of the first."""

    def __init__(self, master: Strings, duplicates: Strings | None = None, corpus: str = "refit", **options):
        if corpus not in ("refit", "frozen"):
            raise ValueError("corpus is 'refit' or 'frozen'")
        self.corpus_mode, self._frozen, self._frozen_by = corpus, None, None
        self.options = self._checked(MatchOptions(), options)
        self.reset_data(master, duplicates)

    @staticmethod
    def _checked(base: MatchOptions, options: dict) -> MatchOptions:
        if unknown := options.keys() - MatchOptions.names():
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(base, **options)

    # -- data and options

    def reset_data(self, master: Strings, duplicates: Strings | None = None) -> None:
        if duplicates is not None and (master.id is None) != (duplicates.id is None):
            raise ValueError("give an id for both inputs or for none")
        self._master, self._duplicates = master, duplicates
        self._validate()
        self.is_build, self._left, self._right, self._matches = False, None, None, None

    def clear_data(self) -> None:
        self._master = self._duplicates = self._left = self._right = self._matches = None
        self.is_build = False

    def update_options(self, **options) -> None:
        self.options = self._checked(self.options, options)
        self._validate()
        self.is_build = False

    def _grams_by(self) -> tuple:
        """The options that make grams: weights learned under others are of no use."""
        o = self.options
        return o.ngram_size, o.regex, o.ignore_case, o.normalize_to_ascii, o.tokenizer

    def _learns(self) -> bool:
        """Whether weights are to be learned, rather than frozen ones taken."""
        return self.corpus_mode == "refit" or self._frozen is None or self._frozen_by != self._grams_by()

    def _validate(self) -> None:
        if self.options.replace_na and self._master is not None:
            if self._duplicates is None:
                raise ValueError("replace_na needs duplicates")
            if len(self._master.index) != len(self._duplicates.index):
                raise ValueError("replace_na needs as many index columns of master as of duplicates")

    @property
    def master(self) -> Strings | None:
        return self._master

    @master.setter
    def master(self, master: Strings) -> None:
        self.reset_data(master, self._duplicates)

    @property
    def duplicates(self) -> Strings | None:
        return self._duplicates

    @duplicates.setter
    def duplicates(self, duplicates: Strings | None) -> None:
        self.reset_data(self._master, duplicates)

    def n_grams(self, column):
        """The grams of a string column or of one string."""
        if not isinstance(column, str):
            return grams(plain(column, self.options, False), self.options)
        spark = self._master.df.sparkSession
        one = normalized(spark.createDataFrame([(column,)], "s string"), "s", self.options, "form")
        return one.select(grams(F.col("form"), self.options)).first()[0]

    # -- building

    def _counts(self, rows: DataFrame) -> DataFrame:
        """Counts of the grams of ``rows`` (form, form_text), from which weights are learned unless frozen ones are there."""
        counts, n = vectors.counts_of(rows, self.options)
        if self._learns():
            self._frozen_by = self._grams_by()
            self._frozen = written(vectors.corpus(counts, n), "corpus")
        return counts

    def learn(self) -> MatchSession:
        """Learns weights from master alone; a frozen session then keeps these."""
        self._counts(self._master.rows(self.options).select("form", "form_text"))
        return self

    def _vectors(self) -> tuple[DataFrame, DataFrame]:
        """Postings of the forms of either side; weights come from both sides' rows together."""
        left = self._left.select("form", "form_text")
        both = left if self._duplicates is None else left.unionByName(self._right.select("form", "form_text"))
        counts = self._counts(both)
        postings = written(vectors.vectors(counts, self._frozen, self.options), "postings")
        if self._duplicates is None:
            return postings, postings
        dealt = postings.repartition(-(-postings.count() // vectors.POSTINGS) or 1, "form")
        return tuple(dealt.join(side.select("form").distinct(), "form", "left_semi") for side in (self._left, self._right))

    def _load(self) -> None:
        self._left = written(self._master.rows(self.options), "left")
        self._right = self._left if self._duplicates is None else written(self._duplicates.rows(self.options), "right")

    def fit(self) -> MatchSession:
        self._load()
        same = self._duplicates is None
        frozen = None if self._learns() else self._frozen
        made = vectors.vectors_of(self._left, None if same else self._right, frozen, self.options)
        if frozen is None:
            self._frozen, self._frozen_by = made.corpus, self._grams_by()
        self._pairs = pairs = written(matching.pairs_by_number(made, self.options, same), "pairs")
        matches, total = matching.best_n(pairs, self._left, self._right, self.options)
        if same and self.options.force_symmetries:
            matches = matching.symmetric(matches, total, self._left)
        self._matches = written(matches, "matches")
        self.is_build = True
        return self

    def dot(self) -> DataFrame:
        """(index columns of master, similarity): the similarity of each master row with the duplicate at its position."""
        if self._duplicates is None:
            raise ValueError("dot needs duplicates")
        self._load()
        if self._left.count() != self._right.count() or not self._left.join(self._right, "pos", "left_anti").isEmpty():
            raise ValueError("both inputs need the same rows")
        left, right = self._vectors()
        pairs = self._left.select("pos", F.col("form").alias("lform")).join(self._right.select("pos", F.col("form").alias("rform")), "pos")
        forms = pairs.select("lform", "rform").distinct()
        products = forms.join(left.select(F.col("form").alias("lform"), "gram", F.col("w").alias("lw")), "lform").join(right.select(F.col("form").alias("rform"), "gram", F.col("w").alias("rw")), ["rform", "gram"])
        dots = products.groupBy("lform", "rform").agg(F.sum(F.col("lw") * F.col("rw")).alias("similarity"))
        found = pairs.join(dots, ["lform", "rform"], "left").select("pos", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
        named = zip(self._master.index_columns(), self._master.index_names())
        return self._left.join(found, "pos").select(*[F.col(c).alias(n) for c, n in named], "similarity")

    # -- results

    @property
    @fitted
    def match_list(self) -> DataFrame:
        """(left_pos, right_pos, similarity)."""
        return self._matches

    @fitted
    def get_matches(self, ignore_index: bool | None = None, include_zeroes: bool | None = None) -> DataFrame:
        """The pair table: left index, string, id, similarity, right id, string and (in reverse) index."""
        o = self.options
        ignore_index = o.ignore_index if ignore_index is None else ignore_index
        include_zeroes = o.include_zeroes if include_zeroes is None else include_zeroes
        matches, m, d = self._matches, self._master, self._duplicates or self._master
        if o.min_similarity <= 0 and include_zeroes:
            if o.max_n_matches < matching.most_matches(self._pairs, self._left, self._right, o):
                raise ValueError("max_n_matches leaves out matches that would then be given as zero; raise it or set include_zeroes to False")
            matches = matching.with_zeroes(matches, self._left, self._right)
        joined, names = matches, {}
        for side, of, strings in (("left", self._left, m), ("right", self._right, d)):
            index = [] if ignore_index else list(zip(strings.index_columns(), strings.index_names()))
            ids = [("id", strings.id)] if strings.id else []
            chosen = [*index, ("string", strings.label or "side"), *ids] if side == "left" else [*ids, ("string", strings.label or "side"), *index[::-1]]
            # by place, as an id may be an index column too
            names[side] = [F.col(f"{side}{k}").alias(f"{side}_{n}") for k, (_, n) in enumerate(chosen)]
            joined = joined.join(of.select(F.col("pos").alias(f"{side}_pos"), *[F.col(c).alias(f"{side}{k}") for k, (c, _) in enumerate(chosen)]), f"{side}_pos")
        return joined.select(*names["left"], "similarity", *names["right"])

    @fitted
    def get_groups(self, ignore_index: bool | None = None, replace_na: bool | None = None) -> DataFrame:
        """A row for each string, in no order, led by its position: its group's representative, or (with duplicates) each duplicate's nearest master."""
        o = self.options
        ignore_index = o.ignore_index if ignore_index is None else ignore_index
        replace_na = o.replace_na if replace_na is None else replace_na
        if self._duplicates is None:
            return self._deduplicated(ignore_index)
        return self._nearest(ignore_index, replace_na)

    def _deduplicated(self, ignore_index: bool) -> DataFrame:
        m, rows = self._master, self._left
        reps = grouping.groups(self._matches, rows, self.options.group_rep)
        ids = [F.col("id").alias(f"group_rep_{m.id}")] if m.id else []
        index = [] if ignore_index else [F.col(c).alias(f"group_rep_{n}") for c, n in zip(m.index_columns(), m.index_names())]
        string = F.col("string").alias(f"group_rep_{m.label}" if m.label else "group_rep")
        return reps.select("pos", "rep").join(rows.withColumnRenamed("pos", "rep").withColumn("pos", F.col("rep")).select("rep", F.struct(*ids, *index, string).alias("s")), "rep").select("pos", "s.*")

    def _nearest(self, ignore_index: bool, replace_na: bool) -> DataFrame:
        m, d = self._master, self._duplicates
        if replace_na and ignore_index:
            raise ValueError("replace_na needs the index columns that ignore_index leaves out")
        if replace_na and len(m.index) != len(d.index):
            raise ValueError("replace_na needs as many index columns of master as of duplicates")
        best = grouping.nearest(self._matches).withColumnRenamed("right_pos", "pos")
        masters = self._left.select(F.col("pos").alias("left_pos"), F.struct(*[F.col(c) for c in self._left.columns if c not in ("form", "form_text")]).alias("m"))
        found = self._right.join(best, "pos", "left").join(masters, "left_pos", "left")
        fall = F.col("left_pos").isNull()
        columns = [F.col("pos")]
        if not ignore_index:
            for mc, dc, name in zip(m.index_columns(), [*d.index_columns(), *[None] * len(m.index)], m.index_names()):
                value = F.col(f"m.{mc}")
                columns.append((F.when(fall, F.col(dc)).otherwise(value) if replace_na else value).alias(f"most_similar_{name}"))
        if m.id:
            columns.append(F.when(fall, F.col("id")).otherwise(F.col("m.id")).alias(f"most_similar_{m.id}"))
        columns.append(F.when(fall, F.col("string")).otherwise(F.col("m.string")).alias(f"most_similar_{m.label or 'master'}"))
        return found.select(*columns)

    # -- corrections

    def _keys(self, side: DataFrame, string: str) -> DataFrame:
        found = side.where(F.col("string") == string).select("pos")
        if found.isEmpty():
            raise ValueError(f"no row has the string {string!r}")
        return found

    @fitted
    def add_match(self, master_side: str, dupe_side: str) -> MatchSession:
        """Every row of one string matches every row of the other with 1, and in a self-match so do the rows that match the latter already."""
        left, right = self._keys(self._left, master_side), self._keys(self._right, dupe_side)
        if self._duplicates is None:
            prior = self._matches.join(right.withColumnRenamed("pos", "right_pos"), "right_pos", "left_semi").select(F.col("left_pos").alias("pos"))
            right = right.union(prior).distinct()
        new = left.select(F.col("pos").alias("left_pos")).crossJoin(right.select(F.col("pos").alias("right_pos"))).withColumn("similarity", F.lit(1.0))
        if self._duplicates is None:
            new = new.unionByName(new.select(F.col("right_pos").alias("left_pos"), F.col("left_pos").alias("right_pos"), "similarity"))
        new = new.dropDuplicates(["left_pos", "right_pos"])
        old = self._matches.join(new, ["left_pos", "right_pos"], "left_anti")
        self._matches = written(old.unionByName(new), "matches")
        return self

    @fitted
    def remove_match(self, master_side: str, dupe_side: str) -> MatchSession:
        """No row of one string matches a row of the other any more; in a self-match that holds both ways, and for rows of either string with themselves."""
        left, right = self._keys(self._left, master_side), self._keys(self._right, dupe_side)
        if self._duplicates is None:
            left = right = left.union(right).distinct()
        gone = left.select(F.col("pos").alias("left_pos")).crossJoin(right.select(F.col("pos").alias("right_pos")))
        self._matches = written(self._matches.join(gone, ["left_pos", "right_pos"], "left_anti"), "matches")
        return self

    # -- queries that share the session

    def match_strings(self, master: Strings, duplicates: Strings | None = None, **options) -> DataFrame:
        self._again(master, duplicates, options)
        return self.get_matches()

    def match_most_similar(self, master: Strings, duplicates: Strings, **options) -> DataFrame:
        self._again(master, duplicates, options)
        return self.get_groups()

    def group_similar_strings(self, strings: Strings, **options) -> DataFrame:
        self._again(strings, None, options)
        return self.get_groups()

    def compute_pairwise_similarities(self, one: Strings, two: Strings, **options) -> DataFrame:
        self.options = self._checked(self.options, options)
        self.reset_data(one, two)
        return self.dot()

    def _again(self, master: Strings, duplicates: Strings | None, options: dict) -> None:
        self.options = self._checked(self.options, options)
        self.reset_data(master, duplicates)
        self.fit()


def attached(df: DataFrame, result: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` with the columns of a result by its key columns."""
    return df.join(result, list(key), "left")
