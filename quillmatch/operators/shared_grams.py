"""Pairs of vectors over a threshold, by the sets of grams that they share first.

Grams stand in a fixed order, the rarest first. A key of a vector is a set of its grams, taken as the first that it shares with another: the grams in between are then not shared, and what is left
of its norm bounds the dot product. Keys of one gram are enough where few vectors have them; a key that makes many pairs is told apart by the next shared gram, or by there being none.
Every pair over the threshold meets under one key exactly: that of its first shared grams. So pairs need no deduplication, and are verified where they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.operators.positions import with_positions
from quillmatch.shared import written

#: A key is told apart by further grams if it makes more than so many pairs for each longer key, up to keys of DEPTH grams.
WORTH, DEPTH = 6, 6
#: ... and is left alone if the longer ones make more than this share of its pairs.
GAIN = 0.5
#: Pairs of one key that a task takes; a key of more is dealt out.
DEALT = 4_000_000
#: Slack of bounds, for sums in another order.
SLACK = 1e-9


def ordered_vectors(left: DataFrame, right: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(f, g, w, b, m) of either side's postings (form, gram, w): grams by rank and their weights, the squared norm before each and in all. Grams that no pair can share are left out.

    ``right`` None: pairs are sought within ``left``."""
    counts = left.groupBy("gram").agg(F.count("*").alias("n"))
    if right is None:
        counts = counts.where("n > 1")
    else:
        counts = counts.join(right.groupBy("gram").agg(F.count("*").alias("k")), "gram").select("gram", (F.col("n").cast("double") * F.col("k")).alias("n"))
    ranks = written(with_positions(counts, "g", ["n", "gram"]).select("gram", F.col("g").cast("int").alias("g")), "ranks")
    square = F.col("w") * F.col("w")
    before = F.sum(square).over(W.partitionBy("form").orderBy("g").rowsBetween(W.unboundedPreceding, W.currentRow)) - square

    def side(postings: DataFrame) -> DataFrame:
        placed = postings.join(ranks, "gram").select("form", "g", "w", before.alias("b"))
        v = placed.groupBy(F.col("form").alias("f")).agg(F.sort_array(F.collect_list(F.struct("g", "w", "b"))).alias("v"), F.sum(square).alias("m"))
        return written(v.select("f", *[F.col(f"v.{c}").alias(c) for c in "gwb"], "m"), "vectors")

    one = side(left)
    return (one, one) if right is None else (one, side(right))


def _bounds(left: DataFrame, right: DataFrame) -> list[float]:
    """Mean and greatest squared norms of either side."""
    return [x or 0.0 for side in (left, right) for x in side.agg(F.avg("m"), F.max("m")).first()]


#: A key as a row: the vector, the key and the one it extends, its number of grams, the place of its last gram, the squared norm of grams before that which aren't shared, what can be shared at
#: most, whether no further gram is shared, and how many longer keys there are.
KEY = ["f", "key", "parent", "depth", "p", "u", "a", "closed", "longer"]


def _with_longer(keys: DataFrame, least: float) -> DataFrame:
    """The columns of ``KEY``. Grams after a key stand in order, so the longer ones whose bound holds are counted by the norm before them."""
    at = F.col("b")[F.col("p")] + F.pow(F.col("w")[F.col("p")], F.lit(2.0))
    longer = F.size(F.filter(F.slice("b", F.col("p") + 2, F.size("b")), lambda x: x < F.col("m") - least - F.col("u") + at)) + 1
    return keys.where(F.col("a") > least).withColumn("longer", F.when(F.col("closed"), 0).otherwise(longer)).select(*KEY)


def _first_keys(vectors: DataFrame, least: float) -> DataFrame:
    """Keys of one gram."""
    keys = vectors.select("f", "g", "w", "b", "m", F.posexplode("b").alias("p", "u"))
    columns = {"key": F.col("g")[F.col("p")].cast("string"), "parent": F.lit(""), "a": F.col("m") - F.col("u"), "closed": F.lit(False), "depth": F.lit(1)}
    return _with_longer(keys.withColumns(columns), least)


def _longer_keys(keys: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Every key with each gram that may be shared next, and closed: with none."""
    at = F.col("b")[F.col("p")] + F.pow(F.col("w")[F.col("p")], F.lit(2.0))
    opened = keys.select("f", "key", "p", "u", "depth").join(vectors, "f")
    opened = opened.select("f", "g", "w", "b", "m", "key", "p", "u", "depth", at.alias("at"), F.posexplode("b").alias("q", "bq")).where("q >= p")
    closed = F.col("q") == F.col("p")
    u = F.when(closed, F.col("u")).otherwise(F.col("u") + F.col("bq") - F.col("at"))
    a = F.when(closed, F.col("at") - F.col("u")).otherwise(F.col("m") - u)
    key = F.concat("key", F.lit(","), F.when(closed, F.lit("")).otherwise(F.col("g")[F.col("q")].cast("string")))
    out = opened.select("f", "g", "w", "b", "m", F.col("q").alias("p"), u.alias("u"), key.alias("key"), F.col("key").alias("parent"), a.alias("a"), closed.alias("closed"), F.when(closed, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"))
    return _with_longer(out, least)


def _verified(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Of vectors that meet under a key, those whose first shared grams the key holds and whose product is over ``t``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, of, grams, weights = batch.num_rows, {}, {}, {}
        for side in "xy":
            g = batch.column(f"{side}g")
            of[side] = np.repeat(np.arange(n, dtype=np.int64), np.diff(g.offsets.to_numpy()))
            grams[side], weights[side] = (batch.column(f"{side}{c}").flatten().to_numpy(zero_copy_only=False) for c in "gw")
        # pairs and grams in one order, in which those of y are sought
        width = 1 + max(int(grams[s].max()) for s in "xy")
        sought, there = (of[s] * width + grams[s] for s in "xy")
        at = np.minimum(np.searchsorted(there, sought), len(there) - 1)
        shared = there[at] == sought
        upto = sought <= (np.arange(n, dtype=np.int64) * width + batch.column("last").to_numpy())[of["x"]]
        depth, closed = batch.column("depth").to_numpy(), batch.column("closed").to_numpy(zero_copy_only=False)
        first = np.bincount(of["x"][shared & upto], minlength=n) == depth
        first &= ~closed | (np.bincount(of["x"][shared], minlength=n) == depth)
        product = np.bincount(of["x"], np.where(shared, weights["x"] * weights["y"][at], 0.0), minlength=n)
        kept = pa.array(first & (product > t))
        yield pa.RecordBatch.from_arrays([batch.column("xf").filter(kept), batch.column("yf").filter(kept), pa.array(product).filter(kept)], ["xf", "yf", "similarity"])


def similar(left: DataFrame, right: DataFrame | None, t: float) -> DataFrame:
    """(lform, rform, similarity) of different vectors of ``ordered_vectors`` with a dot product over ``t`` > 0. ``right`` None: each pair of different ones of ``left`` once, the lesser form first."""
    same = right is None
    sides = [left] if same else [left, right]
    mean_l, most_l, mean_r, most_r = _bounds(left, left if same else right)
    square = t * t - SLACK
    leasts = [square / max(most_r, SLACK), square / max(most_l, SLACK)]
    # of two vectors of a pair one has strong keys: weak ones never meet
    strong_l = t if same or not mean_l or not mean_r else t * (mean_l / mean_r) ** 0.5
    strong = [F.col("a") >= strong_l - SLACK, F.col("a") >= t * t / strong_l - SLACK]
    level = [written(_first_keys(v, least), "keys") for v, least in zip(sides, leasts)]
    found, longer = [], None
    for depth in range(1, DEPTH + 1):
        counted = []
        for k, keys in enumerate(level):
            counted.append(keys.select("key", "parent", "closed", strong[k].alias("s"), F.lit(k).alias("side"), "longer"))
        rows = counted[0] if same else counted[0].unionByName(counted[1])
        sums = [F.sum(F.when((F.col("side") == k) & (F.col("s") == s), 1.0).otherwise(0.0)).alias(c) for c, k, s in (("ls", 0, True), ("lw", 0, False), ("rs", 1, True), ("rw", 1, False))]
        pairs = F.expr("ls * (ls - 1) / 2 + ls * lw" if same else "ls * (rs + rw) + lw * rs")
        by_key = rows.groupBy("key", "parent", "closed").agg(*sums, F.sum("longer").cast("double").alias("longer")).withColumn("pairs", pairs).where("pairs > 0")
        apart = F.lit(depth < DEPTH) & ~F.col("closed") & (F.col("pairs") > WORTH * F.col("longer"))
        by_key = written(by_key.select("key", "parent", "pairs", apart.alias("apart"), F.ceil(F.col("pairs") / DEALT).cast("int").alias("parts")), "keys")
        if longer is not None:
            # keys that longer ones don't tell apart stay as they were
            below = by_key.groupBy(F.col("parent").alias("key")).agg(F.sum("pairs").alias("below"))
            settled = written(longer.join(below, "key", "left").select("key", "parts", (F.coalesce("below", F.lit(0.0)) > GAIN * F.col("pairs")).alias("stays")), "keys")
            found.append([keys.join(settled.where("stays").select("key", "parts"), "key") for keys in above])
            by_key = by_key.join(settled.where("not stays").select(F.col("key").alias("parent")), "parent", "left_semi")
        found.append([keys.join(by_key.where("not apart").select("key", "parts"), "key") for keys in level])
        longer = by_key.where("apart")
        if longer.isEmpty():
            break
        above, level = level, [written(_longer_keys(keys.join(longer.select("key"), "key", "left_semi"), v, least), "keys") for keys, v, least in zip(level, sides, leasts)]
    ends = []
    for k, v in enumerate(sides):
        end = reduce(DataFrame.unionByName, [keys[k] for keys in found])
        ends.append(end.select("f", "key", "parts", "depth", "p", "a", "closed", strong[k].alias("s")).join(v.select("f", "g", "w"), "f"))
    x, y = ends[0], ends[-1]
    if same:
        x = x.where("s")
    x = x.select("key", F.pmod(F.xxhash64("f"), "parts").cast("int").alias("part"), *[F.col(c).alias(f"x{c}") for c in "fgwpas"], "closed", "depth")
    y = y.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"y{c}") for c in "fgwas"])
    met = x.join(y, ["key", "part"]).where("xf <> yf").where("not ys or xf < yf" if same else "xs or ys").where(F.col("xa") * F.col("ya") > square)
    met = met.select("xf", "yf", "depth", "closed", F.col("xg")[F.col("xp")].alias("last"), "xg", "xw", "yg", "yw")
    out = met.mapInArrow(partial(_verified, t=t), "xf long, yf long, similarity double")
    return out.select((F.least("xf", "yf") if same else F.col("xf")).alias("lform"), (F.greatest("xf", "yf") if same else F.col("yf")).alias("rform"), "similarity")
