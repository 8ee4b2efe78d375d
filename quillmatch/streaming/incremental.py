"""Matching a stream of new strings against fixed masters, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillmatch.session import MatchSession, Strings


def match_stream(stream: DataFrame, column: str, master: Strings, sink: Callable[[DataFrame, int], None], id: str | None = None, index: tuple[str, ...] = (), **options):
    """A stream writer (start it with a checkpoint location) that gives ``sink`` each batch's pair table and number. Weights are learned from the masters
    alone, so they don't depend on batches and are the same after a restart. The masters are read again for each batch."""
    session = MatchSession(master, corpus="frozen", **options).learn()

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(session.match_strings(master, Strings(batch, column, id=id, index=index)), number)

    return stream.writeStream.foreachBatch(each)
