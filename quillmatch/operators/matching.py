"""The similarity join: pairs of rows whose strings' vectors have a cosine over a threshold, the best n of each row.

Similarity depends on normalised strings alone, so it is computed between distinct forms, with an exact prefix filter, and then
joined to rows. Of the rows of one form, a row's best n matches can hold the first n by position only; no others are expanded, which
keeps strings of very many rows from making the square of their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.config import MatchOptions
from quillmatch.operators.blocks import best_by_blocks
from quillmatch.operators.shared_grams import ordered_vectors, similar
from quillmatch.operators.skew import join_unique
from quillmatch.operators.vectors import Vectors, prefixes
from quillmatch.shared import written

#: Work of a candidate by prefix, against a product of two postings: it is deduplicated, and then verified gram by gram.
VERIFY = 4.0
#: Beyond FEW products forms are compared block against block. Beyond MUCH pairs of a posting of either side, which say how often blocks are moved, they are compared by sets of shared grams, unless
#: they have LONG grams or more on average: those sets carry whole vectors.
FEW, MUCH, LONG = 5e6, 1e14, 200
#: Matches of a task that makes them symmetric.
MATCHES = 500_000
#: Falling thresholds, for up to STEPWISE matches of a row.
STEPS, STEPWISE = (0.75, 0.6, 0.45), 100


def products(left: DataFrame, right: DataFrame) -> float:
    """The number of pairs of postings with the same gram."""
    counts = [side.groupBy("gram").agg(F.count("*").cast("double").alias(n)) for side, n in ((left, "n"), (right, "m"))]
    return counts[0].join(counts[1], "gram").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0]


def prefix_pays(left: DataFrame, right: DataFrame, least: float) -> bool:
    """Whether candidates by prefixes, each of which is verified with whole postings, are less work than all products. With a low threshold prefixes hold most grams.

    Both are exact; the counts of grams decide, so nothing but two numbers reaches the driver."""
    return VERIFY * products(prefixes(left, least), prefixes(right, least)) < products(left, right)


def grams_of_a_form(postings: DataFrame) -> float:
    """The mean number of different grams."""
    n, forms = postings.agg(F.count("*"), F.approx_count_distinct("form")).first()
    return n / max(forms, 1)


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("rform").alias("lform"), F.col("lform").alias("rform"), "similarity"))


def equal_forms(vectors: Vectors) -> DataFrame:
    """Pairs of forms with themselves: a form with grams has similarity 1 to itself."""
    return vectors.table.where("l and r").select(F.col("f").alias("lform"), F.col("f").alias("rform"), F.lit(1.0).alias("similarity"))


def form_pairs(vectors: Vectors, options: MatchOptions, same: bool) -> DataFrame:
    """(lform, rform, similarity) over the threshold. ``same``: both sides are the same forms; pairs are then mirrored."""
    t = options.min_similarity
    left, right = vectors.postings("l"), vectors.postings("r")
    by_prefix = t > 0 and prefix_pays(left, right, t)
    l = left.select(F.col("form").alias("lform"), "gram", F.col("w").alias("lw"))  # noqa: E741
    r = right.select(F.col("form").alias("rform"), "gram", F.col("w").alias("rw"))
    if by_prefix:
        lp = prefixes(left, t).withColumnRenamed("form", "lform")
        rp = prefixes(right, t).withColumnRenamed("form", "rform")
        candidates = lp.join(rp, "gram").where("lform < rform" if same else "lform <> rform").select("lform", "rform").distinct()
        products = candidates.join(l, "lform").join(r, ["rform", "gram"])
    else:
        products = l.join(r, "gram").where("lform < rform" if same else "lform <> rform")
    pairs = products.groupBy("lform", "rform").agg(F.sum(F.col("lw") * F.col("rw")).alias("similarity")).where(F.col("similarity") > t)
    if same:
        pairs = mirrored(pairs)
    return pairs.unionByName(equal_forms(vectors)) if t < 1 else pairs


def best_forms(pairs: DataFrame, options: MatchOptions) -> DataFrame:
    """The pairs that can hold one of the best n matches of a row: for each form those with fewer than n better ones. Ties stay, as positions decide them."""
    near = "lform" if options.topn_side == "left" else "rform"
    rank = F.rank().over(W.partitionBy(near).orderBy(ranked("similarity").desc()))
    return pairs.withColumn("__k", rank).where(F.col("__k") <= options.max_n_matches).drop("__k")


def best_by_steps(vectors: Vectors, options: MatchOptions, same: bool) -> DataFrame:
    """What ``best_forms`` keeps of ``form_pairs``, for many forms: thresholds fall in steps, and a form with n matches over one is not looked at again. All of its best n are over
    that threshold, ties among them too; the last step's is the one asked for."""
    n, t = options.max_n_matches, options.min_similarity
    near, far = ("lform", "rform") if options.topn_side == "left" else ("rform", "lform")
    left = vectors.postings("l")
    sides = ordered_vectors(left, None if same else vectors.postings("r"))
    sides = sides if near == "lform" else sides[::-1]
    equal = equal_forms(vectors)
    rest = vectors.table.where(near[0]).select(F.col("f").alias(near))
    steps = [*(s for s in STEPS if s > t + 0.05 and n <= STEPWISE), t]
    found = []
    for k, s in enumerate(steps):
        if same and k == 0:
            pairs = mirrored(similar(sides[0], None, s))
        else:
            looking = sides[0] if k == 0 else written(sides[0].join(rest.select(F.col(near).alias("f")), "f", "left_semi"), "vectors")
            pairs = similar(looking, sides[1], s).select(F.col("lform").alias(near), F.col("rform").alias(far), "similarity")
        if s < 1:
            pairs = pairs.unionByName(equal if k == 0 else equal.join(rest, near, "left_semi"))
        pairs = written(best_forms(pairs, options), "best")
        if k == len(steps) - 1:
            return reduce(DataFrame.unionByName, [*found, pairs])
        # similarities that count as equal lie on one side of the threshold
        enough = written(pairs.where(F.col("similarity") > s + 1e-8).groupBy(near).count().where(F.col("count") >= n).select(near), "enough")
        found.append(pairs.join(enough, near, "left_semi"))
        rest = written(rest.join(enough, near, "left_anti"), "rest")


def pairs_by_number(vectors: Vectors, options: MatchOptions, same: bool) -> DataFrame:
    """The pairs of ``form_pairs`` that ``best_forms`` keeps, if matches must be over 0 (else results may need to know how many there are). Forms and grams stand as numbers in
    between, which are smaller to move and faster to group by."""
    if options.min_similarity > 0:
        if vectors.all[0] * vectors.all[1] > MUCH and max(grams_of_a_form(vectors.postings(side)) for side in "lr") < LONG:
            pairs = best_by_steps(vectors, options, same)
        elif vectors.products > FEW:
            pairs = best_by_blocks(vectors, options.min_similarity, options.max_n_matches, options.topn_side)
            pairs = best_forms(pairs.unionByName(equal_forms(vectors)) if options.min_similarity < 1 else pairs, options)
        else:
            pairs = best_forms(form_pairs(vectors, options, same), options)
    else:
        pairs = form_pairs(vectors, options, same)
    for side in ("lform", "rform"):
        pairs = pairs.withColumnRenamed(side, "number").join(vectors.numbers.withColumnRenamed("form", side), "number").drop("number")
    return pairs


def ranked(c: str) -> F.Column:
    """Similarities that differ by the order of summation only are equal."""
    return F.round(c, 9)


def best_n(pairs: DataFrame, left: DataFrame, right: DataFrame, options: MatchOptions) -> tuple[DataFrame, int]:
    """(left_pos, right_pos, similarity): the rows of ``left`` and ``right`` (pos, form), of each left row (or each right one) the best n, ties by position. And how many these are."""
    n = options.max_n_matches
    near, far = ("l", "r") if options.topn_side == "left" else ("r", "l")
    sides = {"l": left, "r": right}
    # the first n rows of a form by position
    first = sides[far].withColumn("__k", F.row_number().over(W.partitionBy("form").orderBy("pos"))).where(F.col("__k") <= n)
    # and of each form the best n rows, which are those of each of its rows
    of_form = pairs.join(first.select(F.col("form").alias(f"{far}form"), F.col("pos").alias("far")), f"{far}form")
    rank = F.row_number().over(W.partitionBy(f"{near}form").orderBy(ranked("similarity").desc(), "far"))
    best = of_form.withColumn("__k", rank).where(F.col("__k") <= n).groupBy(F.col(f"{near}form").alias("form")).agg(F.collect_list(F.struct("far", "similarity")).alias("found"))
    # a form of very many rows is dealt out
    best = written(best.join(sides[near].groupBy("form").agg(F.count("*").alias("m")), "form"), "best")
    total = best.agg(F.coalesce(F.sum(F.col("m") * F.size("found")), F.lit(0))).first()[0]
    rows = join_unique(sides[near].select("form", F.col("pos").alias("near")), best, "form", "m").select("near", F.explode("found").alias("found")).select("near", "found.far", "found.similarity")
    at = {near: "near", far: "far"}
    return rows.select(F.col(at["l"]).alias("left_pos"), F.col(at["r"]).alias("right_pos"), "similarity"), total


def most_matches(pairs: DataFrame, left: DataFrame, right: DataFrame, options: MatchOptions) -> int:
    """The largest number of matches that a row has before the best n are taken."""
    near, far = ("l", "r") if options.topn_side == "left" else ("r", "l")
    rows = (right if far == "r" else left).groupBy(F.col("form").alias(f"{far}form")).count()
    return pairs.join(rows, f"{far}form").groupBy(f"{near}form").agg(F.sum("count").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def symmetric(matches: DataFrame, total: int, rows: DataFrame) -> DataFrame:
    """``matches`` of a self-join, ``total`` of them, with every row matching itself with 1 and every pair both ways."""
    others = matches.where("left_pos <> right_pos")
    both = others.unionByName(others.select(F.col("right_pos").alias("left_pos"), F.col("left_pos").alias("right_pos"), "similarity"))
    # a pair occurs twice at most: moved first, as an aggregate before that would only hold all of a task's pairs
    both = both.repartition(-(-2 * total // MATCHES) or 1, "left_pos", "right_pos")
    diagonal = rows.select(F.col("pos").alias("left_pos"), F.col("pos").alias("right_pos"), F.lit(1.0).alias("similarity"))
    return both.groupBy("left_pos", "right_pos").agg(F.max("similarity").alias("similarity")).unionByName(diagonal)


def with_zeroes(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows, those that don't match with 0. What the caller asks for grows as the product of the sides."""
    pairs = left.select(F.col("pos").alias("left_pos")).crossJoin(right.select(F.col("pos").alias("right_pos")))
    missing = pairs.join(matches, ["left_pos", "right_pos"], "left_anti").withColumn("similarity", F.lit(0.0))
    return matches.unionByName(missing)
