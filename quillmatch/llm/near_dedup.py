"""Near-duplicates by ProbMinHash.

Method: a text is its set of runs of five words, each weighted by 1 + ln(occurrences). A run with weight w has a Poisson process
of arrivals with rate w; every arrival falls on one of ``BANDS * ROWS`` registers, and a register keeps the run that arrives first. Two
texts agree in a register with the probability Jaccard similarity of their weighted runs. A process ends as soon as its next arrival comes after
the last register's first one, so long texts need little more than one arrival per run. Bands of registers give candidates, and
candidates are verified with their whole run sets.

Texts are linked if either their weighted runs or their plain run sets are similar enough, so a text with repeated runs has a second sketch, with all weights 1. Arrivals depend on run
and rate only, so for a text without repeated runs both sketches are one. A pair is likely if either kind of registers agrees often enough.

Shape: exact copies are collapsed by content first, so a group of copies of any size is one candidate. In a bucket of at most ``WHOLE`` texts the pairs of which
enough registers agree are its likely ones; a maximum spanning forest of them, fewer pairs than texts, is verified, and links become classes by connected components in the
shared folder. The texts of a larger bucket are compared with three hubs of it instead. A bucket is settled when the ends of its forest's pairs are in one class each: then so are
those of all its likely pairs, tried or not. Of the others (a pair of the forest failed; hubs left several classes) the texts outside the largest class are weighed against all of other classes,
in blocks of about ``WHOLE`` by ``WHOLE`` texts spread over tasks; the run sets of texts with a likely pair travel, and links that tie classes are what comes out. So
every likely pair of two classes is verified, in buckets of every size, and the rows of each step grow with the texts and not with their pairs.

Recall of one comparison at similarity 0.8 (of either kind): 24 bands of 5 share a bucket with a probability above 0.9999, and LIKELY then passes over fewer than 0.01 of the pairs.

Cases: null counts as empty text. Texts without a word have no runs and share a class with byte-equal texts only. Texts of under five
words are one run. Words are runs of letters and digits in either case. Repeated rows are exact copies. Empty tables give empty results. Extra
columns don't matter to ``near_duplicates``, and ``one_of_each`` keeps them. A null key stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.rows import map_blocks, maybe_among
from quillmatch.llm.words import mix, shingles, utf8, words
from quillmatch.operators.components import components
from quillmatch.operators.skew import fresh, join_unique
from quillmatch.shared import written

BANDS, ROWS, WORDS, SIMILARITY = 24, 5, 5, 0.8
#: Share of agreeing registers: 2.7 standard deviations below SIMILARITY. Buckets of more than WHOLE texts are taken apart.
LIKELY, WHOLE = 0.7, 400
#: Bytes of text at a time in the array code.
STEP = 1 << 19
#: Bytes of text on either side of a block; its run sets are about as many.
BLOCK = 16 << 20


def weighted(data, offsets):
    """(runs, weights, index of each text's first): distinct runs of five words of each text, ascending."""
    runs, begin = shingles(*(lambda w: (w[0], w[3]))(words(data, offsets)), WORDS)
    if not len(runs):
        return runs, np.empty(0), begin
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.concatenate([[True], (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(runs)]]))
    return runs[at], 1 + np.log(counts), np.searchsorted(text[at], np.arange(len(begin)))


def sketch(runs: np.ndarray, weights: np.ndarray, begin: np.ndarray, registers: int) -> np.ndarray:
    """(texts, registers) the run that arrives first at each register; 0 for texts without runs."""
    n = len(begin) - 1
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    text = np.repeat(np.arange(n), np.diff(begin))
    run, rate, time = runs, weights, np.zeros(len(runs))
    state = runs.copy()
    while len(run):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / rate
        at = text * registers + (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        early = time < first[at]
        np.minimum.at(first, at[early], time[early])
        won = early & (time == first[at])
        held[at[won]] = run[won]
        last = first.reshape(n, registers).max(1)
        on = time < last[text]
        run, rate, time, text, state = run[on], rate[on], time[on], text[on], state[on]
    return held.reshape(n, registers)


def keys_and_marks(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of each text's registers, and a byte of each register."""
    bands = held.reshape(-1, BANDS, ROWS)
    keys = np.full(bands.shape[:2], 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ bands[:, :, r]) * np.uint64(0x9FB21C651E98DF25)
    return keys.view(np.int64), (mix(held) >> np.uint64(56)).astype(np.uint8)


def band_keys(column: pa.Array) -> list:
    """[band keys, a byte of each register] for the texts: those of the weighted runs, followed by those of the plain ones where a run is repeated; none for a text without runs."""
    out, marks = [], []
    total = max(1, column.nbytes)
    step = max(1, int(len(column) * STEP / total))
    for i in range(0, len(column), step):
        runs, weights, begin = weighted(*utf8(column.slice(i, step)))
        sizes = np.diff(begin)
        keys, bytes_ = keys_and_marks(sketch(runs, weights, begin, BANDS * ROWS))
        text = np.repeat(np.arange(len(sizes)), sizes)
        again = np.bincount(text[weights > 1], minlength=len(sizes)) > 0
        own = again[text]
        plain = sketch(runs[own], np.ones(int(own.sum())), np.concatenate([[0], np.cumsum(sizes[again])]), BANDS * ROWS)
        more = iter(zip(*keys_and_marks(plain)))
        for k, m, s, two in zip(keys, bytes_, sizes > 0, again):
            k2, m2 = next(more) if two else (k[:0], m[:0])
            out.append(np.concatenate([k, k2]) if s else [])
            marks.append(m.tobytes() + m2.tobytes() if s else b"")
    return [out, marks]


def both_kinds(rows: list, dtype) -> np.ndarray:
    """(texts, 2, n): the weighted and the plain band keys or marks of texts; texts without repeated runs have them once."""
    rows = [np.frombuffer(r, dtype) if isinstance(r, bytes) else np.asarray(r, dtype) for r in rows]
    n = BANDS * ROWS if dtype is np.uint8 else BANDS
    return np.stack([np.resize(r, (2, n)) for r in rows])


def agreement(marks: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The larger share of registers of either kind in which texts agree with one."""
    return (marks == one).mean(2).max(1)


def forest(ids: list[bytes], marks: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the likely pairs of a bucket's texts, by agreeing registers (Prim). Ties go by the ids, so forests of buckets that share
    texts choose the same pairs."""
    n = len(ids)
    tie = mix(np.frombuffer(b"".join(i[:8] for i in ids), np.uint64)) >> np.uint64(44)
    weight, parent, out = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    least, pairs, i = int(np.ceil(LIKELY * BANDS * ROWS)) << 20, [], 0
    for _ in range(n - 1):
        out[i] = False
        now = ((marks == marks[i]).sum(2).max(1) << 20) + (tie ^ tie[i]).astype(np.int64)
        better = out & (now > weight)
        weight[better], parent[better] = now[better], i
        i = int(np.where(out, weight, -2).argmax())
        if weight[i] >= least:
            pairs.append((int(parent[i]), i))
    return pairs


def whole_groups(batches, column: int):
    """Batches cut so that rows of one value of a column, which is sorted, are in one."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        value = batch.column(column).to_numpy()
        cut = int(np.searchsorted(value, value[-1]))
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def bucket_forests(batches):
    """(a, b, bucket, n): the forests of buckets of at most ``WHOLE`` texts. ``batches`` have bucket (sorted), id and marks."""
    for batch in whole_groups(batches, 0):
        bucket, ids, marks = batch.column(0).to_numpy(), batch.column(1).to_pylist(), both_kinds(batch.column(2).to_pylist(), np.uint8)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(first, len(bucket)))
        two = first[size == 2]  # most of them
        likely = two[(marks[two] == marks[two + 1]).mean(2).max(1) >= LIKELY]
        found = [(i, i + 1, 2) for i in likely.tolist()]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            found += ((at + i, at + j, n) for i, j in forest(ids[at : at + n], marks[at : at + n]))
        if found:
            a, b = ([min(ids[i], ids[j]) for i, j, _ in found], [max(ids[i], ids[j]) for i, j, _ in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(bucket[[i for i, _, _ in found]]), pa.array([n for _, _, n in found], pa.int64())], names=["a", "b", "bucket", "n"]
            )


def run_sets(column: pa.Array) -> list:
    """For each text its distinct runs and their weights as bytes (uint64, float32)."""
    out = []
    step = max(1, int(len(column) * STEP / max(1, column.nbytes)))
    for i in range(0, len(column), step):
        runs, weights, begin = weighted(*utf8(column.slice(i, step)))
        b = begin.tolist()
        # 32 bits of a run tell it from the others of two texts; the cut is sorted again.
        for s, e in zip(b, b[1:]):
            short = (runs[s:e] >> np.uint64(32)).astype(np.uint32)
            out.append(short.tobytes() + weights[s:e].astype(np.float16).tobytes())
    return out


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint32, n), np.frombuffer(packed, np.float16, n, 4 * n).astype(np.float64)


def probability_jaccard(x: np.ndarray, y: np.ndarray, only_x: float, only_y: float) -> float:
    """Of the weights x and y of the common runs, with the total weights of the others: sum over common d of 1 / sum over d' of max(x' / x, y' / y)."""
    if not len(x):
        return 0.0
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    # For d, runs with a larger x' / y' count by x' / x, the others by y' / y.
    below_y = np.cumsum(y)
    above_x = x.sum() - np.cumsum(x)
    return float((1 / ((above_x + only_x) / x + (below_y + only_y) / y)).sum())


def similarity(a: bytes, b: bytes) -> float:
    """The larger of the Jaccard similarity of the run sets and the probability Jaccard similarity of the weighted runs."""
    (ra, wa), (rb, wb) = unpack(a), unpack(b)
    common, i, j = np.intersect1d(ra, rb, return_indices=True)
    if not len(common):
        return 0.0
    plain = len(common) / (len(ra) + len(rb) - len(common))
    x, y = wa[i], wb[j]
    return max(plain, probability_jaccard(x, y, wa.sum() - x.sum(), wb.sum() - y.sum()))


def content(text) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Block:
    """Texts of a bucket's rest (``rest`` true) and all texts that they are weighed against. A pair is weighed in the first bucket that it shares only: in a smaller one of two texts it
    failed, and a bucket is settled only if it holds no likely pair of two classes."""

    def __init__(self, table: pa.Table):
        self.rest = table.column("rest").to_numpy(zero_copy_only=False).astype(bool)
        self.ids, codes = table.column("id").to_pylist(), {}
        self.group = np.array([codes.setdefault(c, len(codes)) for c in table.column("component").to_pylist()], np.int64)
        self.bucket = table.column("bucket")[0].as_py()
        self.bands = both_kinds(table.column("bands").to_pylist(), np.int64).reshape(len(self.ids), -1)
        self.marks = both_kinds(table.column("marks").to_pylist(), np.uint8)
        self.others = np.flatnonzero(~self.rest)

    def partners(self, i: int) -> np.ndarray:
        """Texts that are likely near-duplicates of ``i`` and in another class, the likeliest first."""
        others = self.others[self.group[self.others] != self.group[i]]
        agree = agreement(self.marks[others], self.marks[i])
        others, agree = others[agree >= LIKELY], agree[agree >= LIKELY]
        if not len(others):
            return others
        here = self.bands[i][(self.bands[others] == self.bands[i]).argmax(1)] == self.bucket
        return others[here][np.argsort(-agree[here], kind="stable")]


def wanted_of_block(table: pa.Table) -> pa.Table:
    """The rows of a block that are part of a likely pair of two classes."""
    block = Block(table)
    wanted = np.zeros(len(block.ids), bool)
    for i in np.flatnonzero(block.rest):
        near = block.partners(int(i))
        wanted[near] = True
        wanted[i] = len(near) > 0
    return table.filter(pa.array(wanted))


def links_of_block(table: pa.Table) -> pa.Table:
    """The links of a block that tie classes."""
    block, runs, links = Block(table), table.column("runs"), []
    for i in np.flatnonzero(block.rest).tolist():
        own = runs[i].as_py()
        for j in block.partners(i).tolist():
            if block.group[i] != block.group[j] and similarity(own, runs[j].as_py()) >= SIMILARITY:
                links.append((min(block.ids[i], block.ids[j]), max(block.ids[i], block.ids[j])))
                block.group[block.group == block.group[i]] = block.group[j]
    return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})


def unsettled(members: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, id, component, most) of the buckets that may hold a likely pair of two classes; ``most`` is the class of most texts."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class")).hint("merge")
    tried = edges.where("n > 2").join(of("a"), "a", "left").join(of("b"), "b", "left")
    failed = tried.where(F.coalesce("a_class", "a") != F.coalesce("b_class", "b")).select("bucket").distinct()
    some = members.where(F.col("n") > WHOLE).unionByName(members.where(F.col("n") <= WHOLE).join(failed.hint("merge"), "bucket", "left_semi")).select("bucket", "id")
    some = some.join(classes.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = some.groupBy("bucket", "component").agg(F.count("*").alias("texts"))
    split = sizes.groupBy("bucket").agg(F.count("*").alias("classes"), F.max_by("component", F.struct("texts", "component")).alias("most")).where("classes > 1")
    return some.join(split.select("bucket", "most").hint("merge"), "bucket")


def links_of_rest(left: DataFrame, contents: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links that tie the classes of ``left``, found in blocks of about ``WHOLE`` texts, or ``BLOCK`` bytes of text, by as many."""
    rest = F.col("component") != F.col("most")
    full = written(left.join(contents.select("id", "marks", "bands", "size").hint("merge"), "id"), "rest")
    parts = lambda one: F.greatest(F.ceil(F.sum(one) / WHOLE), F.ceil(F.sum(one * F.col("size")) / BLOCK), F.lit(1))
    counts = full.groupBy("bucket").agg(parts(F.lit(1)).alias("across"), parts(rest.cast("int")).alias("down"))
    full = full.join(counts.hint("merge"), "bucket")
    columns = ("bucket", "id", "component", "marks", "bands")
    part = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    one = full.where(rest).select(*columns, F.lit(True).alias("rest"), part(F.col("down"), 1).alias("row"), every("across").alias("column"))
    all_ = full.select(*columns, F.lit(False).alias("rest"), every("down").alias("row"), part(F.col("across"), 2).alias("column"))
    blocks = one.unionByName(all_)
    wanted = written(blocks.groupBy("bucket", "row", "column").applyInArrow(wanted_of_block, blocks.schema), "wanted")
    sets = sets_of(rows, wanted.select("id"))
    return wanted.join(sets.hint("merge"), "id").groupBy("bucket", "row", "column").applyInArrow(links_of_block, "a binary, b binary").distinct()


def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are near-duplicates."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("runs").alias("__b")), "b").join(sets.select(F.col("id").alias("a"), F.col("runs").alias("__a")), "a")

    def make():
        def run(block):
            a, b = (block.column(block.schema.get_field_index(c)).to_pylist() for c in ("__a", "__b"))
            return [[similarity(x, y) for x, y in zip(a, b)]]

        return run

    return map_blocks(both.select("a", "b", "__a", "__b"), make, "similarity double", drop=["__a", "__b"]).where(F.col("similarity") >= SIMILARITY)


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, runs): the run sets of the contents whose id is in ``ids``."""
    wanted = written(ids.distinct(), "wanted")
    few = maybe_among(rows.select("id", "text"), F.col("id"), wanted).where("__maybe").select("id", "text")
    # One text per content and map task travels, however many copies there are.
    found = few.groupBy("id").agg(F.first("text").alias("text")).join(wanted.hint("merge"), "id", "left_semi")
    return written(map_blocks(found, lambda: lambda block: [run_sets(block.column(block.schema.get_field_index("text")))], "runs binary", drop=["text"]), "runs")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per content of ``rows`` (key, text, id): id, n_copies, the class's id (class_key, class_texts), and its representative:
    rep_id and rep_key, with rep_rows, the number of rows of that content and key."""
    sized = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    sketched = map_blocks(sized, lambda: lambda block: band_keys(block.column(block.schema.get_field_index("text"))), "bands array<long>, marks binary", drop=["text"])
    # One row per content: the exchange carries a content and key from a map task at most once.
    same = [F.first(c).alias(c) for c in ("bands", "marks", "size")]
    by_key = sketched.groupBy("id", "key").agg(F.count("*").alias("n"), *same)
    least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "n")).alias("least")
    contents = written(by_key.groupBy("id").agg(least, F.sum("n").alias("n_copies"), *same), "contents")
    entries = contents.select("id", "marks", F.explode(F.array_distinct("bands")).alias("bucket"))
    # Few buckets have several contents: their entries alone travel.
    shared = written(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    some = maybe_among(entries, F.col("bucket"), shared.select("bucket")).where("__maybe").drop("__maybe")
    members = written(some.join(shared.hint("merge"), "bucket"), "members")
    small = members.where(F.col("n") <= WHOLE).select("bucket", "id", "marks").repartition("bucket").sortWithinPartitions("bucket")
    edges = written(small.mapInArrow(bucket_forests, "a binary, b binary, bucket long, n long"), "edges")
    # Three hubs of each larger bucket.
    large = members.where(F.col("n") > WHOLE).select("bucket", "id")
    hub = lambda k: F.min_by("id", F.xxhash64("id", "bucket", F.lit(k)))
    hubs = large.groupBy("bucket").agg(F.array_distinct(F.array(F.min("id"), F.max("id"), hub(2))).alias("hubs"))
    stars = large.join(hubs.hint("merge"), "bucket").select("id", F.explode("hubs").alias("hub")).where("id <> hub")
    tried = written(edges.select("a", "b").unionByName(stars.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))).distinct(), "pairs")
    classes = components(links_of(tried, sets_of(rows, tried.select(F.col("a").alias("id")).union(tried.select("b")))).select("a", "b"))
    left = written(unsettled(members, edges, classes), "unsettled")
    if not left.isEmpty():
        more = written(links_of_rest(left, contents, rows), "links")
        if not more.isEmpty():
            classes = components(more.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classed = contents.select("id", "least", "n_copies").join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_class = classed.groupBy("component").agg(F.min(F.struct("least.none", "least.key", "id", "least.n")).alias("rep"), F.count("*").alias("class_texts"))
    return classed.join(of_class, "component").select("id", "n_copies", "class_texts", F.col("rep.key").alias("rep_key"), F.col("rep.id").alias("rep_id"), F.col("rep.n").alias("rep_rows"))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), content(F.col(f"`{text}`")).alias("id"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_copies, class_texts): for every row of ``df`` the class of near-duplicates that it belongs to.

    class_id is the least key of the class's rows (null only if all are null), n_copies the number of rows with the row's content, and class_texts the
    number of different contents of the class.
    """
    rows = keyed(df, key, text)
    classes = written(classes_of(rows), "classes")
    # Keys and contents only.
    return join_unique(rows.select("key", "id"), classes, "id", "n_copies").select(F.col("key").alias(key), F.col("rep_key").alias("class_id"), "n_copies", "class_texts")


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least key of each class of near-duplicates (null keys last), with all its columns, whatever their names; of several rows with that key and content one stays."""
    classes = written(classes_of(keyed(docs, key, text)), "classes")
    # A row whose content is in no other row and in a class of its own stays, without an exchange.
    others = written(classes.where("n_copies > 1 or class_texts > 1").select("id"), "others")
    own, of_key, count, maybe = fresh(docs.columns, "content", "of_key", "count", "maybe")
    marked = maybe_among(docs.withColumns({own: content(F.col(f"`{text}`")), of_key: F.xxhash64(F.col(f"`{key}`"))}), F.col(own), others, maybe)
    reps = classes.where("id = rep_id").select(F.col("id").alias(own), F.xxhash64("rep_key").alias(of_key), F.col("rep_rows").alias(count))
    held = marked.where(maybe).join(reps.hint("merge"), [own, of_key])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    several = held.where(F.col(count) > 1).dropDuplicates([own])
    return marked.where(~F.col(maybe)).select(*columns).union(held.where(F.col(count) == 1).select(*columns)).union(several.select(*columns))
