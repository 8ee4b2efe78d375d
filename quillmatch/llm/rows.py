"""What the row-wise operators share: bounded Arrow blocks and columns with clashing names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.operators.skew import fresh

#: Bytes of column data that one call of a block function gets, but for a single longer row.
BLOCK_BYTES = 8 << 20


def blocks(batch: pa.RecordBatch, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about ``limit`` bytes, one row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, int(rows * limit / max(1, batch.nbytes))))
    for i in range(0, rows, step):
        yield batch.slice(i, step)


def give_back() -> None:
    """Returns the memory that a task has freed to the system: workers live on, and wait beside those of other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_blocks(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], added: str, drop: Iterable[str] = ()) -> DataFrame:
    """Adds columns row by row: ``make()`` is called once a task and gives a function from a block to lists of values.

    ``added`` is a DDL string of the new columns. Columns of ``df`` of the same names are replaced, those in ``drop``
    are read but not returned.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    drop = {d.lower() for d in drop}
    taken = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in drop | taken]
    names = [f.name for f in kept]
    out = StructType([*kept, *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)
    added_types = [target.field(f.name).type for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for block in blocks(whole):
                values = function(block)
                columns = [block.column(block.schema.get_field_index(n)) for n in names]
                columns += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in zip(values, added_types)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in new]])
        del function
        give_back()

    return df.mapInArrow(run, out)


#: Bits of a filter for each value, and of a whole filter: 32 MB are broadcast at most.
BITS_EACH, BITS_MOST, PAGE = 16, 1 << 28, 1 << 15


def maybe_among(df: DataFrame, value: Column, wanted: DataFrame, name: str = "__maybe") -> DataFrame:
    """``df`` with a boolean column that is true for each row whose ``value`` is in the only column of ``wanted``, and for some others.

    An exact join of the rows that are true, which then are few, must follow; the others need no exchange. The filter has a bit for the hash of each
    value, in pages of ``PAGE`` bits. Its size is bounded: far beyond ``BITS_MOST / BITS_EACH`` values it is true for most rows, which costs
    time and no results. ``wanted`` is read twice, so it should be a written table.
    """
    bits = 1 << 20
    while bits < min(BITS_MOST, BITS_EACH * wanted.count()):
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    of = slot(F.col(f"`{wanted.columns[0]}`"))
    pages = wanted.groupBy(F.floor(of / PAGE).alias("__page")).agg(F.bitmap_construct_agg(of % PAGE).alias("__bits"))
    at = slot(value)
    page, held_bits = fresh(df.columns, "page", "bits")
    held = df.join(F.broadcast(pages.select(F.col("__page").alias(page), F.col("__bits").alias(held_bits))), F.floor(at / PAGE) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(held_bits, F.floor(at % PAGE / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(hit, F.lit(False)).alias(name))


def texts(block: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a block; null is the empty text."""
    return [t or "" for t in block.column(block.schema.get_field_index(column)).to_pylist()]
