"""Pairs of vectors over a threshold, block against block.

Each side is dealt into blocks of a bounded number of postings, and each block of one meets each of the other in one task: what is moved are vectors, not candidates. A task first looks at what shares
two rare grams with a vector, which is little, and is done with the vector if its best n are better than anything that shares fewer can be. Otherwise it adds up the products of the vector's rare grams, and of as many more as it takes for the rest of a pair to be under the threshold by itself; the norms of what is left bound a pair from above, and what was added up bounds it
from below, which shows early what can't be among the best n. Only pairs that are left get their whole product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators.vectors import Vectors

#: Postings of a block, at most (blocks are dealt by a hash), and how many pairs of blocks there are at least, if there are so many forms.
BLOCK, TASKS = 3_000_000, 32
#: Partitions for each pair of blocks, so that few of them hold two pairs.
SPREAD = 3
#: Grams of under this share of a block's vectors are rare.
RARE = 1 / 128
#: Products, cells of weights and pairs in hand at once.
PRODUCTS, CELLS, PAIRS = 2_000_000, 2_000_000, 100_000
#: Pairs of rare grams of a block's vectors, at most, for a list by such pairs.
COUPLES = 4_000_000
#: Slack of bounds, for sums in another order, and of similarities that count as equal.
SLACK, EQUAL = 1e-9, 1e-8


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of spans, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _couples(grams: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All couples of postings of one vector, from each vector's grams, one after another, and from how many each has: places of the first postings, and of the second."""
    ends = np.repeat(np.cumsum(own), own)
    after = ends - np.arange(len(grams)) - 1
    return np.repeat(np.arange(len(grams)), after), _spans(np.arange(1, len(grams) + 1), after)


def _greatest(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The greatest value of each group, 0 at least."""
    out = np.zeros(size)
    np.maximum.at(out, groups, values)
    return out


def _nth(rows: np.ndarray, values: np.ndarray, n: int, size: int) -> np.ndarray:
    """The n-th greatest value of each row; minus infinity if it has fewer."""
    order = np.lexsort((-values, rows))
    counts = np.bincount(rows, minlength=size)
    at = np.cumsum(counts) - counts + n - 1
    out = np.full(size, -np.inf)
    out[counts >= n] = values[order[at[counts >= n]]]
    return out


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Forms, number of grams of each, grams and weights."""
    lists = [table.column(c).combine_chunks() for c in "gw"]
    g, w = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists)
    return table.column("f").to_numpy(), np.diff(g.offsets.to_numpy()).astype(np.int64), g.flatten().to_numpy(), w.flatten().to_numpy()


def best_of_blocks(near: pa.Table, far: pa.Table, t: float, n: int) -> pa.Table:
    """(near, far, similarity): of each vector of ``near`` the best n others of ``far`` with a product over ``t`` > 0, and those equal to the last of them."""
    out = pa.schema([("near", pa.int64()), ("far", pa.int64()), ("similarity", pa.float64())])
    if not near.num_rows or not far.num_rows:
        return out.empty_table()
    rf, rn, rg, rw = _columns(far)
    # grams by their number of vectors in the block; postings of far by vector, and their places by gram
    grams, rl = np.unique(rg, return_inverse=True)
    df = np.bincount(rl, minlength=len(grams))
    by_df = np.argsort(df, kind="stable")
    place = np.empty_like(by_df)
    place[by_df] = np.arange(len(grams))
    rl, df, v = place[rl], df[by_df], len(grams)
    rare = int(np.searchsorted(df, max(1, len(rf) * RARE), "right"))
    row, begin = np.repeat(np.arange(len(rf)), rn), np.cumsum(rn) - rn
    # of a gram the vectors with the greatest norms of grams that aren't rare come first
    r_rest = np.sqrt(np.bincount(row, np.where(rl < rare, 0.0, rw * rw), minlength=len(rf)))
    by_rest = np.argsort(-r_rest, kind="stable")
    rank = np.empty_like(by_rest)
    rank[by_rest] = np.arange(len(rf))
    by_gram = rl * len(rf) + rank[row]
    places, gram_begin = np.argsort(by_gram), np.cumsum(df) - df
    by_gram = by_gram[places]
    # postings of near whose grams occur, by vector and number of vectors in the block
    qf, qn, qg, qw = _columns(near)
    ql = np.minimum(np.searchsorted(grams, qg), v - 1)
    there = grams[ql] == qg
    q, ql, qw = np.repeat(np.arange(len(qf)), qn)[there], place[ql[there]], qw[there]
    order = np.argsort(q * v + ql)
    q, ql, qw = q[order], ql[order], qw[order]
    q_begin = np.searchsorted(q, np.arange(len(qf) + 1))
    upto = np.concatenate([[0.0], np.cumsum(qw * qw)])
    from_on = np.sqrt(np.maximum(upto[q_begin[q + 1]] - upto[:-1], 0.0))
    q_rest = np.sqrt(np.bincount(q, np.where(ql < rare, 0.0, qw * qw), minlength=len(qf)))
    # vectors of far by couples of their rare grams
    is_rare, q_rare = rl < rare, ql < rare
    couples = np.bincount(row[is_rare], minlength=len(rf))
    listed = int((couples * (couples - 1) // 2).sum()) <= COUPLES
    if listed:
        c_row, c_gram = row[is_rare], rl[is_rare]
        order = np.argsort(c_row * v + c_gram)
        c_row, c_gram = c_row[order], c_gram[order]
        one, two = _couples(c_gram, couples)
        c_row, c_one, c_two, c_place = c_row[one], c_gram[one], c_gram[two], np.argsort(c_gram[one] * v + c_gram[two], kind="stable")
        c_w, c_w2 = (rw[is_rare][order][k] for k in (one, two))
        c_keys, c_begin, c_count = np.unique((c_one * v + c_two)[c_place], return_index=True, return_counts=True)
        c_bits = max(int(len(c_row) - 1).bit_length(), 1)
    # what a pair with fewer than two rare grams in common can have at most
    r_square = rw * rw + (r_rest * r_rest)[row]
    g_most, g_rest, g_square = (_greatest(rl[is_rare], x[is_rare], v) for x in (rw, r_rest[row], r_square))
    x, w, rest = q[q_rare], qw[q_rare], q_rest[q[q_rare]]
    single = np.minimum(w * g_most[ql[q_rare]] + rest * g_rest[ql[q_rare]], np.sqrt((w * w + rest * rest) * g_square[ql[q_rare]]))
    fewer = np.maximum(_greatest(x, single, len(qf)), q_rest * r_rest.max()) + SLACK
    # how many of a gram's vectors the posting meets: all, or those that the rest of the vector could take over the threshold
    able = np.searchsorted(-r_rest[by_rest], -np.maximum(t - SLACK, 0.0) / np.maximum(from_on, SLACK))
    met = np.where(ql < rare, df[ql], np.searchsorted(by_gram, ql * len(rf) + able) - gram_begin[ql])
    work = np.concatenate([[0], np.cumsum(np.bincount(q, met, minlength=len(qf)).astype(np.int64))])
    bits = max(int(len(rg) - 1).bit_length(), 1)
    most = max(1, min(CELLS // v, 1 << 12))
    cells, found, a = np.zeros(most * v), [], 0

    def whole(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The products of vectors of near, which are in the cells, and of far."""
        out = [np.zeros(0)]
        for k in range(0, len(x), PAIRS):
            i, j = x[k : k + PAIRS], y[k : k + PAIRS]
            e = _spans(begin[j], rn[j])
            out.append(np.add.reduceat(cells[np.repeat(i * v, rn[j]) + rl[e]] * rw[e], np.cumsum(rn[j]) - rn[j]))
        return np.concatenate(out)

    while a < len(qf):
        b = min(max(int(np.searchsorted(work, work[a] + PRODUCTS, "right")) - 1, a + 1), a + most, len(qf))
        s = slice(q_begin[a], q_begin[b])
        at = (q[s] - a) * v + ql[s]
        cells[at] = qw[s]
        lengths, least_of, settled = met[s], np.full(b - a, t), np.zeros(b - a, bool)
        own = np.bincount(q[s][q_rare[s]] - a, minlength=b - a)
        if listed and len(c_keys):
            # of vectors with few couples, against what they meet otherwise
            few = own * (own - 1) <= np.diff(work[a : b + 1])
            chosen = q_rare[s] & few[q[s] - a]
            x, gram = (q[s] - a)[chosen], ql[s][chosen]
            one, two = _couples(gram, np.where(few, own, 0))
            keys, x = gram[one] * v + gram[two], x[one]
            place_of = np.minimum(np.searchsorted(c_keys, keys), len(c_keys) - 1)
            there_are = np.where(c_keys[place_of] == keys, c_count[place_of], 0)
            few &= 2 * np.bincount(x, there_are, minlength=b - a) <= np.diff(work[a : b + 1])
            there_are[~few[x]] = 0
            kind = np.uint32 if (b - a) << c_bits < 1 << 32 else np.int64
            keys = np.repeat((x << c_bits).astype(kind), there_are) | c_place[_spans(c_begin[place_of], there_are)].astype(kind)
            keys.sort()  # by vector of near, then by vector of far
            x, e = (keys >> c_bits).astype(np.int64), (keys & ((1 << c_bits) - 1)).astype(np.int64)
            y = c_row[e]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
            if len(x):
                # of k shared grams each is in k - 1 couples
                many = np.diff(np.append(first, len(x)))
                least = np.add.reduceat(cells[x * v + c_one[e]] * c_w[e] + cells[x * v + c_two[e]] * c_w2[e], first) / np.round((np.sqrt(1 + 8 * many) - 1) / 2)
                x, y = x[first], y[first]
                kept = qf[a + x] != rf[y]
                x, y, least = x[kept], y[kept], least[kept]
                kept = least + q_rest[a + x] * r_rest[y] >= _nth(x, least, n, b - a)[x] - EQUAL
                x, y = x[kept], y[kept]
            product = whole(x, y)
            best = _nth(x, product, n, b - a)
            settled = few & ((best - EQUAL > fewer[a:b]) | (t >= fewer[a:b]))
            least_of = np.maximum(t, best - EQUAL)
            kept = settled[x] & (product > t) & (product >= best[x] - EQUAL)
            found.append((qf[a + x[kept]], rf[y[kept]], product[kept]))
            lengths = np.where(settled[q[s] - a], 0, lengths)
        if lengths.any():
            kind = np.uint32 if (b - a) << bits < 1 << 32 else np.int64
            keys = np.repeat(((q[s] - a) << bits).astype(kind), lengths) | places[_spans(gram_begin[ql[s]], lengths)].astype(kind)
            keys.sort()  # by vector of near, then by vector of far
            x, e = (keys >> bits).astype(np.int64), (keys & ((1 << bits) - 1)).astype(np.int64)
            y = row[e]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            least = np.add.reduceat(cells[x * v + rl[e]] * rw[e], first)
            x, y = x[first], y[first]
            bound = least + q_rest[a + x] * r_rest[y]
            kept = (bound > least_of[x] - SLACK) & (qf[a + x] != rf[y])
            x, y, least, bound = x[kept], y[kept], least[kept], bound[kept]
            kept = bound >= _nth(x, least, n, b - a)[x] - EQUAL
            x, y = x[kept], y[kept]
            product = whole(x, y)
            kept = product > t
            x, y, product = x[kept], y[kept], product[kept]
            kept = product >= _nth(x, product, n, b - a)[x] - EQUAL
            found.append((qf[a + x[kept]], rf[y[kept]], product[kept]))
        cells[at] = 0.0
        a = b
    return pa.table([pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0), kind) for k, kind in enumerate(out.types)], schema=out)


def best_by_blocks(vectors: Vectors, t: float, n: int, topn_side: str) -> DataFrame:
    """(lform, rform, similarity) of different forms with a similarity over ``t`` > 0: at least all that are among the best n of a form of ``topn_side``."""
    names = ("lform", "rform") if topn_side == "left" else ("rform", "lform")
    counts = vectors.shared if topn_side == "left" else vectors.shared[::-1]
    # what is moved, the one side for each block of the other, is least in this proportion
    far_blocks = max(-(-counts[1] // BLOCK), round((TASKS * counts[1] / max(counts[0], 1)) ** 0.5), 1)
    near_blocks = max(-(-counts[0] // BLOCK), -(-TASKS // far_blocks))

    def dealt(side: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        some = vectors.table.where(F.col(side) & (F.size("g") > 0)).select("f", "g", "w", F.lit(own).alias("own"), F.pmod(F.xxhash64("f"), F.lit(blocks)).cast("int").alias(own))
        return some.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("f", "g", "w", "own", "nb", "fb")

    rows = dealt(names[0][0], "nb", near_blocks, "fb", far_blocks).unionByName(dealt(names[1][0], "fb", far_blocks, "nb", near_blocks))
    # small partitions aren't put together again, as their time is in what they compute
    met = rows.repartition(SPREAD * near_blocks * far_blocks, "nb", "fb").groupBy("nb", "fb")
    got = met.applyInArrow(lambda rows: _met(rows, t, n), "near long, far long, similarity double")
    return got.select(F.col("near").alias(names[0]), F.col("far").alias(names[1]), "similarity").select("lform", "rform", "similarity")


def _met(rows: pa.Table, t: float, n: int) -> pa.Table:
    """``best_of_blocks`` of two blocks in one table."""
    return best_of_blocks(*(rows.filter(pc.equal(rows.column("own"), own)) for own in ("nb", "fb")), t, n)
