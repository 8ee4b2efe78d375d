"""Benchmark decontamination by CGK embedding.

Method: a random walk (Chakraborty, Goldenberg, Koucky, 2016) over a window of words, at each step giving the word under the
pointer and moving on or not by a random bit of step and word, maps edit distance to Hamming distance. Sampling a few output positions and taking them
together is a locality-sensitive hash for it. Each of ``REPEATS`` tables has its own walk, its own positions, and its own
offset into the item at which its windows begin, so that edits anywhere leave tables untouched. Every window of item size of every text, one from each word on,
is looked up.

Walks over words need whole words. Edits spread over characters (typos, OCR) leave few of these, so windows are also found by their characters: runs of ``RUN`` bytes
that a text and an item have in common are counted on nearby diagonals (text place - item place), and an item's window is a candidate where two adjacent bands of
``ACROSS`` diagonals hold one shared run for every ``SHARE`` bytes of the item. Items of under ``SHORT`` characters take shorter runs: as long as the longest that the allowed edits must
leave intact somewhere, and one is enough, so these are always found.

Candidates are dropped only where a passage within the allowed distance is impossible (an edit changes at most q of the item's runs of q bytes, and one more for each byte of a character beyond the first), and the rest is verified by the exact edit
distance in characters between the item and the parts of the region around it (bit-parallel, Myers 1999).

Walks take their bits from the hash of the word, and the sampled steps from the size of the windows, so what is found for an item depends on it and the text alone, not on the
other items. The sampled positions are checked in order and a window leaves the walk at the first that no item has there: the keys are those of the full walk.

The items are the stated query set: blocks of ``ITEM_BLOCK`` of them at most go to the executors (their bytes are checked), and each block passes over all
texts. A worker makes the tables of a block once and keeps those of the last one for its next tasks. Nothing is exchanged.

Recall: an unchanged passage is always found, as all its runs are shared. With single-word edits of one in ten words above 0.95 of the passages of 16 words or more are found, with random character edits
up to ``RATIO`` above 0.9 (tests measure both).

Cases: null text counts as empty; items without a word are never found; equal items are reported each; passages repeated in a text
give one row each unless they overlap; repeated rows give repeated results; empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.words import mix, utf8, words
from quillmatch.operators.skew import fresh

REPEATS, SAMPLES, RATIO = 8, 4, 0.15
RUN, ACROSS, SHARE, SHORT, HITS, LEFT = 8, 32, 24, 40, 2 << 20, (5, 3)
#: Regions of an item that begin within so many bytes are one.
MERGED, SLOT_BITS, FILTER_BITS = 24, 12, 18
ITEM_BLOCK, ITEM_BYTES = 5_000, 16 << 20
STEP = 1 << 19
RESULT = "item_id long, start long, `end` long, distance int"


def matches(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) of every part of ``text`` within ``most`` of ``pattern``: the nearest one for each end."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    masks = dict(masks)
    ones, top = (1 << m) - 1, 1 << m - 1
    up, down, score, found = ones, 0, m, []
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((eq & up) + up ^ up) | x
        right = down | ~(d0 | up) & ones
        left = up & d0
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right <<= 1
        up = (left << 1 | ~(d0 | right)) & ones
        down = right & d0 & ones
        if score <= most:
            found.append((score, j + 1))
    return found


def best_match(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of ``text`` nearest to ``pattern``, the first of several; None beyond ``most``."""
    return min(matches(pattern, text, most), default=None)


def passages(pattern: str, text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the parts of ``text`` within ``most`` of ``pattern``, the nearest first; later ones that overlap are left out."""
    taken: list[tuple[int, int, int]] = []
    least = max(1, len(pattern) - most)
    for distance, end in sorted(matches(pattern, text, most)):
        if any(end - least < e and s < end for s, e, _ in taken):
            continue
        back = [e for d, e in matches(pattern[::-1], text[max(0, end - len(pattern) - most) : end][::-1], distance) if d == distance]
        start = end - min(back, key=lambda e: abs(e - len(pattern)))
        if not any(start < e and s < end for s, e, _ in taken):
            taken.append((start, end, distance))
    return taken


def plain(text: str) -> str:
    """Lower case with one space for every run of white space."""
    return " ".join(text.lower().split())


SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", np.uint8))
#: White space beyond ASCII by its first byte.
WIDE_SPACES = defaultdict(list)
for _c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000":
    WIDE_SPACES[_c.encode()[0]].append(_c.encode())


def spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data`` with one space for every run of white space, and which bytes of it stay."""
    space = SPACE[data]
    padded = np.append(data, np.zeros(2, np.uint8))
    for lead, characters in WIDE_SPACES.items():
        at = np.flatnonzero(data == lead)
        for c in characters if len(at) else ():
            same = at[np.all([padded[at + j] == c[j] for j in range(1, len(c))], axis=0)]
            for j in range(len(c)):
                space[same + j] = True
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    return np.where(space, np.uint8(32), data)[keep], keep


def runs_of(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes (8 at most) from each byte on as a number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(15, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded.data, np.uint64, (len(padded) - k) // 8, k)[: len(out[k::8])]
        out[k::8][: len(part)] = part
    return shortened(out[: len(data)], size)


def shortened(runs: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes of runs of 8."""
    return runs & np.uint64((1 << 8 * size) - 1) if size < 8 else runs


def slots_of(runs: np.ndarray) -> np.ndarray:
    return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)


class Runs:
    """Inverted index of the items' runs of bytes."""

    def __init__(self, patterns: list[str]):
        self.sizes = np.array([len(p.encode()) for p in patterns], np.int64)
        self.need = np.maximum(2, self.sizes // SHARE)
        by = defaultdict(list)
        #: for each item by size of runs: its distinct runs, how often each is there, how many of all ``RATIO`` leaves at least, and how often those of a slot are there
        self.left: list[list[tuple]] = []
        for k, p in enumerate(patterns):
            edits, size = int(RATIO * len(p)), RUN
            if len(p) < SHORT:
                size, self.need[k] = min(RUN, max(1, (len(p) - edits) // (edits + 1))), 1
            data = np.frombuffer(p.encode(), np.uint8)
            self.left.append([])
            for q in LEFT:
                # an edit changes q runs, and one more for each byte of its character beyond the first
                need = len(data) - q + 1 - q * edits - min(len(data) - len(p), 3 * edits)
                if need > 0:
                    own, counts = np.unique(runs_of(data, q)[: len(data) - q + 1], return_counts=True)
                    table = np.bincount(slots_of(own), counts, 1 << SLOT_BITS).astype(np.uint16)
                    self.left[k].append((q, own, counts, need, table))
            runs = runs_of(data, size)[: len(data) - size + 1]
            by[size].append((runs, np.full(len(runs), k), np.arange(len(runs))))
        #: (size of runs, filter, distinct runs, first place of each, item and offset of each place)
        self.index = []
        for size, parts in sorted(by.items()):
            runs, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(runs, kind="stable")
            keys, first = np.unique(runs[order], return_index=True)
            bloom = np.zeros(1 << 22, bool)
            bloom[self.spread(keys)] = True
            self.index.append((size, bloom, keys, np.append(first, len(runs)), item[order], at[order]))

    @staticmethod
    def spread(runs: np.ndarray) -> np.ndarray:
        return (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def possible(self, k: int, runs: dict[int, np.ndarray], slots: dict[int, np.ndarray], low: int, high: int) -> bool:
        """Whether the text from ``low`` to ``high`` holds as many of the item's runs as its allowed edits leave."""
        for q, own, counts, need, table in self.left[k]:
            there = np.zeros(1 << SLOT_BITS, bool)
            there[slots[q][low : max(low, high - q + 1)]] = True
            if table[there].sum() < need:  # slots hold all of their runs, so this is never too low
                return False
        for q, own, counts, need, _ in self.left[k]:
            part = runs[q][low : max(low, high - q + 1)]
            place = own.searchsorted(part)
            place[place == len(own)] = 0
            there = np.zeros(len(own), bool)
            there[place[own[place] == part]] = True
            if counts @ there < need:
                return False
        return True

    def candidates(self, all_runs: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, least, most place where its window may begin) in data with single spaces, given its runs of 8 bytes."""
        found = []
        shift = 1 << 20  # a window may begin before the data
        for size, bloom, keys, first, item, offset in self.index:
            runs = shortened(all_runs[: max(0, len(all_runs) - size + 1)], size)
            at = np.flatnonzero(bloom[self.spread(runs)])
            place = np.minimum(np.searchsorted(keys, runs[at]), len(keys) - 1)
            same = keys[place] == runs[at]
            at, place = at[same], place[same]
            counts = first[place + 1] - first[place]
            ends = np.cumsum(counts)
            cells: list[tuple] = []
            i = 0
            while i < len(at):  # at most about HITS at a time
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, "right")))
                c = counts[i:j]
                which = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[place[i:j]], c)
                key = (item[which] << 40) + (np.repeat(at[i:j], c) - offset[which] + shift)
                key.sort()
                cell = key // ACROSS
                begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                end = np.append(begin[1:], len(key))
                cells.append((cell[begin], end - begin, key[begin], key[end - 1]))
                i = j
            if not cells:
                continue
            cell, n, low, high = (np.concatenate(x) for x in zip(*cells))
            cell, inverse = np.unique(cell, return_inverse=True)
            total, least, most = np.bincount(inverse, n).astype(np.int64), np.full(len(cell), 1 << 62), np.zeros(len(cell), np.int64)
            np.minimum.at(least, inverse, low)
            np.maximum.at(most, inverse, high)
            one = total >= self.need[least >> 40]
            two = np.append((cell[1:] == cell[:-1] + 1) & (total[1:] + total[:-1] >= self.need[least[1:] >> 40]) & ~one[1:] & ~one[:-1], False)
            low_bits = (1 << 40) - 1
            for c in np.flatnonzero(one).tolist():
                # an adjacent band may hold the other hits of the same passage, so its own place is enough
                found.append((int(least[c] >> 40), int(least[c] & low_bits) - shift, int(most[c] & low_bits) - shift))
            for c in np.flatnonzero(two).tolist():
                found.append((int(least[c] >> 40), int(least[c] & low_bits) - shift, int(most[c + 1] & low_bits) - shift))
        return found


class Tables:
    """The hash tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 1):
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        hashes, starts, _, first = words(data, offsets)
        #: where each word begins in the item with single spaces
        places = np.concatenate([[0], np.cumsum(spaced(data)[1])])
        some = np.flatnonzero(np.diff(first) > 0)
        begin, sizes = first[some], np.diff(first)[some]
        self.at = [places[starts[b : b + n]] - places[offsets[i]] for i, b, n in zip(some, begin, sizes)]
        self.items = [(items[i][0], plain(items[i][1]), int(n)) for i, n in zip(some.tolist(), sizes)]
        self.runs = Runs([p for _, p, _ in self.items])
        # the bytes by which so many edits may move a place, with characters as wide as the item's
        self.reach = [int(RATIO * len(p)) * -(-int(b) // len(p)) + 4 for (_, p, _), b in zip(self.items, self.runs.sizes)]
        self.seeds = mix(np.arange(seed, seed + REPEATS // 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        whole = np.left_shift(1, np.frexp(sizes)[1] - 1)  # windows of at least half the item's size
        bits = self.bits(hashes)
        #: (offset, sampled steps, number of the walk, whether a symbol may begin a key, whether two may, keys, items by key)
        self.tables = []
        for size in np.unique(whole).tolist():
            members = np.flatnonzero(whole == size)
            repeats = min(REPEATS, max(1, size))
            for r in range(repeats):
                random = np.random.RandomState([seed, size, r])
                offset = r * max(0, size - min(size, 8)) // max(1, repeats - 1) if repeats > 1 else 0
                room = size - offset
                # the walk moves half the steps, so twice as many cover the window; the second sample is near, to leave most windows early
                steps = [0]
                if room > 1:
                    near = 1 + random.randint(min(3, room - 1))
                    far = np.arange(near + 1, min(2 * room, near + 14))
                    steps += [near, *sorted(random.choice(far, min(SAMPLES - 2, len(far)), replace=False).tolist())] if len(far) else [near]
                begins, seconds, keyed = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << FILTER_BITS, bool), defaultdict(list)
                at = begin[members] + offset
                begins[hashes[at] >> np.uint64(64 - FILTER_BITS)] = True
                key = hashes[at].copy()
                for j, (_, symbols, _) in enumerate(self.walk(hashes, bits, at, begin[members] + sizes[members], steps, r)):
                    key = mix(key ^ symbols)
                    if not j:
                        seconds[key >> np.uint64(64 - FILTER_BITS)] = True
                for k, x in zip(members.tolist(), key.tolist()):
                    keyed[x].append(k)
                keys = np.array(sorted(keyed), np.uint64)
                self.tables.append((offset, steps, r, begins, seconds, keys, [keyed[int(k)] for k in keys]))

    def bits(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Random bits of each word, 32 for each walk."""
        return [mix(hashes ^ s) for s in self.seeds]

    @staticmethod
    def walk(symbols, bits, at, end, steps, r):
        """For each sampled step but the first (indices of walks, symbols there, function that leaves only some walks); symbols are 0 beyond ``end``."""
        last, w, shift, t = len(symbols) - 1, bits[r // 2], 32 * (r % 2), 0
        which, held = np.arange(len(at)), [at, end]
        move, symbol = (w[at] >> np.uint64(shift)) & np.uint64(1), None

        def leave(on):
            nonlocal which, move
            which, move, held[:] = which[on], move[on], [held[0][on], held[1][on]]

        for s in steps[1:]:
            while t < s:
                at = held[0] + move.astype(np.int64)
                held[0], t = at, t + 1
                near = np.minimum(at, last)
                move = (w[near] >> np.uint64(shift + t)) & np.uint64(1)
                move[at >= held[1]] = 0
            symbol = np.where(held[0] < held[1], symbols[np.minimum(held[0], last)], np.uint64(0))
            yield which, symbol, leave

    def hits(self, hashes: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, index of a word, index of the item's word there) for every hit. ``end`` has for each word the end of its text."""
        found = []
        slot, bits = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int32), self.bits(hashes)
        for offset, steps, r, begins, seconds, keys, members in self.tables:
            start = np.flatnonzero(begins[slot])
            key, which = hashes[start], np.arange(len(start))
            for j, (which, symbol, leave) in enumerate(self.walk(hashes, bits, start, end[start], steps, r)):
                key = mix(key ^ symbol)
                if not j:
                    on = np.flatnonzero(seconds[key >> np.uint64(64 - FILTER_BITS)])
                    key, which = key[on], which[on]
                    leave(on)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[place] == key
            for p, i in zip(place[same].tolist(), start[which[same]].tolist()):
                found += ((k, i, offset) for k in members[p])
        return found

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, distance) of the passages in a block of texts; offsets in the lower-cased UTF-8 text."""
        data, offsets = utf8(column)
        hashes, starts, ends, first = words(data, offsets)
        if not len(hashes) or not self.items:
            return []
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        flat, keep = spaced(data)
        place = np.concatenate([[0], np.cumsum(keep)])  # of the bytes in the text with single spaces
        bounds, back = place[offsets], np.append(np.flatnonzero(keep), len(data))
        regions: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        # of the passage the item's part before the word, and the part after it, are moved by the edits there at most
        for k, i, own in self.hits(hashes, first[1:][text]):
            low = int(place[starts[i]]) - int(self.at[k][own])
            regions[int(text[i]), k].append((low - self.reach[k], low + int(self.runs.sizes[k]) + self.reach[k]))
        whole = runs_of(flat, 8)
        for k, low, high in self.runs.candidates(whole):
            reach, size = self.reach[k], int(self.runs.sizes[k])
            row = int(np.searchsorted(bounds, min(max((low + high + size) // 2, 0), len(flat) - 1), "right")) - 1
            regions[row, k].append((low - reach, high + size + reach))
        runs = {q: shortened(whole, q) for q in LEFT}
        slots = {q: slots_of(r) for q, r in runs.items()}
        found = []
        for (row, k), parts in sorted(regions.items()):
            item, pattern, _ = self.items[k]
            most = int(RATIO * len(pattern))
            near: list[list[int]] = []
            for low, high in sorted((max(a, int(bounds[row])), min(z, int(bounds[row + 1]))) for a, z in parts):
                if near and low - near[-1][0] <= MERGED:
                    near[-1][1] = max(near[-1][1], high)
                else:
                    near.append([low, high])
            likely: list[list[int]] = []
            for low, high in near:
                if likely and high <= likely[-1][1] or not self.runs.possible(k, runs, slots, low, high):
                    continue
                if likely and low < likely[-1][1]:
                    likely[-1][1] = high
                else:
                    likely.append([low, high])
            for low, high in likely:
                while low < high and flat[low] & 0xC0 == 0x80:  # begin with a whole character
                    low += 1
                region = bytes(flat[low:high]).decode("utf-8", "ignore")
                for start, end, distance in sorted(passages(pattern, region, most)):
                    a, z = (low + len(region[:x].encode()) for x in (start, end))
                    found.append((row, item, int(back[a] - offsets[row]), int(back[z - 1] + 1 - offsets[row]), distance))
        return found


_kept: dict = {}


def tables_of(items: list[tuple[int, str]]) -> Tables:
    """The tables of a block, from an earlier task of this worker if it was of the same items."""
    key = tuple(items)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Tables(items)
    return _kept[key]


def item_blocks(benchmark: DataFrame, key: str, text: str):
    """The items in bounded blocks."""
    items = benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(-(-n // (ITEM_BLOCK // 2)), -(-2 * size // ITEM_BYTES)) if n > ITEM_BLOCK or size > ITEM_BYTES else 1
    for b in range(blocks if n else 0):
        yield [(r.k, r.t) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()]


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start, end, distance): a row for each passage of ``df`` within an edit distance of ``RATIO`` of an item's length. start and end are
    where it stands, in bytes of the lower-cased text."""
    from functools import reduce

    from pyspark.sql import types as T

    docs = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([docs.schema["key"], *T.StructType.fromDDL(RESULT).fields])
    parts = []
    for items in item_blocks(benchmark, item_key, item_text):
        parts.append(docs.mapInArrow(searcher(items, schema), schema))
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)


def searcher(items: list, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    from quillmatch.llm.rows import blocks, give_back

    out = to_arrow_schema(schema)

    def run(batches):
        tables = tables_of(items)
        for batch in batches:
            for block in blocks(batch, STEP):
                got = tables.search(block.column(1))
                if got:
                    rows = pa.array([g[0] for g in got], pa.int64())
                    columns = [block.column(0).take(rows), *[pa.array([g[j] for g in got], out.field(j).type) for j in range(1, 5)]]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)
        give_back()

    return run


def clean_of(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a passage of an item, whatever their keys and the names of their columns are."""
    from quillmatch.llm.rows import map_blocks

    kept, [leaks] = docs, fresh(docs.columns, "leaks")
    for items in item_blocks(benchmark, "item_id", "text"):

        def make(items=items):
            tables = tables_of(items)

            def run(block):
                from quillmatch.llm.rows import blocks

                flags = []
                for part in blocks(block, STEP):
                    hit = {g[0] for g in tables.search(part.column(part.schema.get_field_index(text)))}
                    flags += [i in hit for i in range(part.num_rows)]
                return [flags]

            return run

        kept = map_blocks(kept, make, f"`{leaks}` boolean").where(~F.col(leaks)).drop(leaks)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
