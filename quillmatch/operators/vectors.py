"""TF-IDF vectors of distinct normalised strings ("forms"): as a table of postings, and as a table of arrays, which are made without a row for each posting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.config import MatchOptions
from quillmatch.functions.text import grams
from quillmatch.shared import written

#: Characters of rows whose grams a task makes, and postings that a task sorts by form.
CHARACTERS, POSTINGS = 500_000, 800_000


def forms_of(rows: DataFrame) -> DataFrame:
    """(form, m, text): distinct normalised strings with the number of their rows. ``form`` may be a short key of them, if rows have form_text."""
    # a form has one text, so both are keys: an aggregate of strings would sort
    return rows.groupBy("form", F.col("form_text" if "form_text" in rows.columns else "form").alias("text")).agg(F.count("*").alias("m")).select("form", "m", "text")


def term_counts(forms: DataFrame, options: MatchOptions) -> DataFrame:
    """(form, m, gram, tf)."""
    return forms.select("form", "m", F.explode(grams(F.col("text"), options)).alias("gram")).groupBy("form", "m", "gram").agg(F.count("*").alias("tf"))


def counts_of(rows: DataFrame, options: MatchOptions) -> tuple[DataFrame, int]:
    """``term_counts`` of the forms of ``rows``, and the number of rows. Forms are dealt to tasks by their characters: grams take many times the bytes by which tasks are put together otherwise."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("form_text" if "form_text" in rows.columns else "form")), F.lit(0))).first()
    return term_counts(forms_of(rows).repartition(-(-size // CHARACTERS) or 1, "form"), options), n


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(gram, df): in how many rows a gram occurs."""
    return counts.groupBy("gram").agg(F.sum("m").alias("df"))


def idf(df: Column, n: Column) -> Column:
    """The smooth inverse document frequency."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + 1


def corpus(counts: DataFrame, n: int) -> DataFrame:
    """(gram, df, idf) of a corpus of ``n`` rows."""
    return document_frequencies(counts).withColumn("idf", idf(F.col("df"), F.lit(n)))


def vectors(counts: DataFrame, corpus: DataFrame, options: MatchOptions) -> DataFrame:
    """(form, gram, df, w): unit vectors. Grams that the corpus lacks are left out."""
    weighted = counts.join(corpus, "gram").select("form", "gram", "df", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("form")))
    return weighted.withColumn("w", (F.col("w") / norm).cast(options.weight_type).cast("double"))


def prefixes(postings: DataFrame, least: float) -> DataFrame:
    """The postings that two vectors of a dot product over ``least`` may share first, with grams in order of rising frequency: those from which on the rest of the
    vector has a norm of ``least`` at least."""
    rest = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("form").orderBy("df", "gram").rowsBetween(W.currentRow, W.unboundedFollowing))
    return postings.withColumn("__rest", rest).where(F.sqrt("__rest") >= least - 1e-9).select("form", "gram")


# -- vectors as arrays

COUNTED = "b long, f long, l boolean, r boolean, k array<int>, tf array<int>, gram string, at int, n long, nl long, nr long"
VECTORS = "f long, l boolean, r boolean, g array<long>, d array<long>, w array<double>"


@dataclass(frozen=True)
class Vectors:
    """numbers: (form, number). table: a row for each form with grams, as in ``VECTORS``: its number, whether it is on the left and on the right side, and its grams that both sides have (or two
    forms, if the sides are the same), their frequencies and weights. corpus: (gram, df, idf). all: postings of either side. shared: those of grams that both have. products: pairs of the latter."""

    numbers: DataFrame
    table: DataFrame
    corpus: DataFrame
    all: tuple[int, int]
    shared: tuple[int, int]
    products: float

    def postings(self, side: str) -> DataFrame:
        """(form, gram, df, w) of the side 'l' or 'r', with numbers for forms and grams."""
        of = self.table.where(side).select("f", F.explode(F.arrays_zip("g", "d", "w")).alias("p"))
        return of.select(F.col("f").alias("form"), F.col("p.g").alias("gram"), F.col("p.d").alias("df"), F.col("p.w").alias("w"))


def _lists(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of a batch of forms with their grams: a row for each form, whose grams are places in the batch's list, and a row for each gram of that list."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("grams")
        lengths, flat = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), column.flatten()
        of = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths)
        if flat.null_count:
            of, flat = of[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
        coded = flat.dictionary_encode()
        v = max(len(coded.dictionary), 1)
        keys, tf = np.unique(of * v + coded.indices.to_numpy(), return_counts=True)
        x, k = keys // v, keys % v
        l, r, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in "lrm")  # noqa: E741
        own = np.bincount(x, minlength=batch.num_rows)
        b = batch.column("f")[0]
        forms = {"b": pa.repeat(b, batch.num_rows), "f": batch.column("f"), "l": batch.column("l"), "r": batch.column("r"), "k": _lists(own, k, pa.int32()), "tf": _lists(own, tf, pa.int32())}
        count = len(coded.dictionary)
        n, nl, nr = (np.zeros(count, np.int64) for _ in range(3))
        for to, add in ((n, m), (nl, l), (nr, r)):
            np.add.at(to, k, add[x].astype(np.int64))
        found = {"b": pa.repeat(b, count), "gram": coded.dictionary, "at": pa.array(np.arange(count), pa.int32()), "n": pa.array(n), "nl": pa.array(nl), "nr": pa.array(nr)}
        for rows, size in ((forms, batch.num_rows), (found, count)):
            yield pa.RecordBatch.from_arrays([rows[c.name].cast(c.type) if c.name in rows else pa.nulls(size, c.type) for c in schema], schema=schema)


def _weighted(forms: pa.Table, grams: pa.Table, single: bool, schema: pa.Schema) -> pa.Table:
    """The rows of ``VECTORS`` of a batch's forms, whose grams' numbers, frequencies and weights are in ``grams``: those that the corpus has."""
    if not forms.num_rows or not grams.num_rows:
        return schema.empty_table()
    k, tf = (forms.column(c).combine_chunks() for c in ("k", "tf"))
    k, tf = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (k, tf))
    of = np.repeat(np.arange(forms.num_rows), pc.list_value_length(k).to_numpy(zero_copy_only=False))
    k, tf = k.flatten().to_numpy(), tf.flatten().to_numpy()
    size = max(int(k.max(initial=0)), pc.max(grams.column("at")).as_py()) + 1
    at = grams.column("at").to_numpy()
    g, d, shared, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size)
    known = np.zeros(size, bool)
    g[at], d[at], shared[at], weight[at], known[at] = (*(grams.column(c).to_numpy() for c in ("g", "df", "shared", "idf")), True)
    w = tf * weight[k]
    square = np.bincount(of, w * w, minlength=forms.num_rows)
    some = np.bincount(of, known[k], minlength=forms.num_rows) > 0
    w /= np.sqrt(np.where(square > 0, square, 1.0))[of]
    if single:
        w = w.astype(np.float32).astype(np.float64)
    kept = shared[k]
    own = np.bincount(of[kept], minlength=forms.num_rows)[some]
    chosen = pa.array(some)
    columns = [*(forms.column(c).filter(chosen) for c in ("f", "l", "r")), *(_lists(own, x, t) for x, t in ((g[k[kept]], pa.int64()), (d[k[kept]], pa.int64()), (w[kept], pa.float64())))]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def vectors_of(left: DataFrame, right: DataFrame | None, frozen: DataFrame | None, options: MatchOptions) -> Vectors:
    """The vectors of the forms of rows (form, form_text) of ``left`` and ``right`` (None: the same), with the weights of ``frozen`` (gram, df, idf), or with those of all these rows.

    Forms are dealt to tasks by their characters, as in ``counts_of``. A batch of them counts its grams by places in its own list; only these lists are joined to the corpus, and so go
    back to the batch. The corpus may have any size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    same = right is None
    sides = left.select("form", "form_text", F.lit(True).alias("l"), F.lit(same).alias("r"))
    if not same:
        sides = sides.unionByName(right.select("form", "form_text", F.lit(False).alias("l"), F.lit(True).alias("r")))
    forms = sides.groupBy("form", F.col("form_text").alias("text")).agg(F.count("*").alias("m"), F.max("l").alias("l"), F.max("r").alias("r"))
    forms = written(forms.withColumn("f", F.monotonically_increasing_id()), "forms")
    n, size = forms.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    made = forms.repartition(-(-size // CHARACTERS) or 1, "f").select("f", "m", "l", "r", grams(F.col("text"), options).alias("grams"))
    schema = to_arrow_schema(_parse_datatype_string(COUNTED))
    counted = written(made.mapInArrow(partial(_counted, schema=schema), COUNTED), "counted")
    lists = counted.where("at is not null").select("b", "gram", "at", "n", "nl", "nr")
    found = lists.groupBy("gram").agg(F.sum("n").alias("df"), F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    known = found.drop("df").join(frozen.select("gram", "df", "idf"), "gram") if frozen is not None else found.withColumn("idf", idf(F.col("df"), F.lit(n)))
    known = written(known.withColumn("shared", F.col("nl") > 1 if same else (F.col("nl") > 0) & (F.col("nr") > 0)).withColumn("g", F.monotonically_increasing_id()), "corpus")
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("nl", "nr", F.when(F.col("shared"), F.col("nl")), F.when(F.col("shared"), F.col("nr")), F.col("nl").cast("double") * F.col("nr"))]
    counts = known.agg(*sums).first()
    of_batch = lists.select("b", "gram", "at").join(known, "gram").select(F.col("b").alias("of"), "at", "g", "df", "shared", "idf").groupBy("of")
    of_forms = counted.where("f is not null").select("b", "f", "l", "r", "k", "tf").groupBy("b")
    weigh = partial(_weighted, single=options.weight_type == "float", schema=to_arrow_schema(_parse_datatype_string(VECTORS)))
    table = written(of_forms.cogroup(of_batch).applyInArrow(weigh, VECTORS), "vectors")
    return Vectors(forms.select("form", F.col("f").alias("number")), table, known.select("gram", "df", "idf"), (counts[0], counts[1]), (counts[2], counts[3]), float(counts[4]))
