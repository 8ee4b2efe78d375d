"""Small inputs with known results, and properties."""

import math
import random
from itertools import combinations

import pytest

from quillmatch import MatchSession, NotFittedError, Strings, compute_pairwise_similarities, group_similar_strings, match_most_similar, match_strings
from quillmatch import shared
from quillmatch.operators.components import components

NAMES = ["Mega Enterprises Corporation", "Hyper Startup Incorporated", "Hyper Startup Inc.", "Hyper-Startup Inc.", "Hyper Hyper Inc.", "Mega Enterprises Corp."]


def strings(spark, values, ids=None, **more):
    rows = [(i, v, *([ids[i]] if ids else [])) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "pos long, s string" + (", id string" if ids and isinstance(ids[0], str) else ", id long" if ids else ""))
    return Strings(df, "s", id="id" if ids else None, key="pos", **more)


def pairs(session):
    return {(r.left_pos, r.right_pos): r.similarity for r in session.match_list.collect()}


def by_pos(df, column):
    return [r[column] for r in df.orderBy("pos").collect()]


def test_groups_centroid_and_first(spark):
    got = group_similar_strings(strings(spark, NAMES), min_similarity=0.6)
    assert by_pos(got, "group_rep_index") == [0, 2, 2, 2, 4, 0]
    assert got.columns == ["pos", "group_rep_index", "group_rep_s"]
    assert by_pos(group_similar_strings(strings(spark, NAMES), min_similarity=0.6, group_rep="first"), "group_rep_index") == [0, 1, 1, 1, 4, 0]


def test_pairwise(spark):
    reps = [NAMES[i] for i in (0, 2, 2, 2, 4, 0)]
    got = [r.similarity for r in compute_pairwise_similarities(strings(spark, NAMES), strings(spark, reps)).orderBy("index").collect()]
    assert got == pytest.approx([1.0, 0.6336195351561589, 1.0, 1.0, 1.0, 0.826462625999832])
    with pytest.raises(ValueError):
        compute_pairwise_similarities(strings(spark, NAMES), strings(spark, reps[:3]))


def test_zeroes(spark):
    got = match_strings(strings(spark, NAMES), strings(spark, ["whatever"]), min_similarity=0).collect()
    assert len(got) == 6 and {r.left_index: round(r.similarity, 8) for r in got} == {0: 0, 1: 0.08170638, 2: 0, 3: 0, 4: 0, 5: 0}
    assert len(match_strings(strings(spark, NAMES), strings(spark, ["whatever"]), min_similarity=0, include_zeroes=False).collect()) == 1
    with pytest.raises(ValueError):
        match_strings(strings(spark, ["BB016741P", "BB082744L", "BB098762D"]), strings(spark, ["BB0", "BB0"]), min_similarity=0, max_n_matches=1)


def test_self_pairs_and_names(spark):
    got = match_strings(strings(spark, ["foo", "bar", "baz", "foo"], ids=["A0", "A1", "A2", "A3"]))
    assert got.columns == ["left_index", "left_s", "left_id", "similarity", "right_id", "right_s", "right_index"]
    assert {(r.left_index, r.right_index, r.similarity) for r in got.collect()} == {(0, 0, 1), (0, 3, 1), (1, 1, 1), (2, 2, 1), (3, 0, 1), (3, 3, 1)}
    df = spark.createDataFrame([(0, "foo", "a", 1), (1, "bar", "b", 2)], "pos long, s string, x string, y long")
    two = match_strings(Strings(df, "s", index=("x", "y"), key="pos", name=None))
    assert two.columns == ["left_x", "left_y", "left_side", "similarity", "right_side", "right_y", "right_x"]
    assert match_strings(Strings(df, "s", key="pos"), ignore_index=True).columns == ["left_s", "similarity", "right_s"]


def test_case_and_two_inputs(spark):
    got = match_strings(strings(spark, ["foo", "BAR", "baz"]), strings(spark, ["FOO", "bar", "bop"]))
    assert {(r.left_index, r.right_index) for r in got.collect()} == {(0, 0), (1, 1)}
    assert match_strings(strings(spark, ["foo", "BAR", "baz"]), strings(spark, ["FOO", "bar", "bop"]), ignore_case=False).count() == 0


def test_diagonal_with_one_match(spark):
    s = MatchSession(strings(spark, [*NAMES, "ab", "ab"]), max_n_matches=1).fit()
    assert {k for k in pairs(s) if k[0] == k[1]} == {(i, i) for i in range(8)}
    assert (6, 7) not in pairs(s)


def test_nearest(spark):
    got = match_most_similar(strings(spark, ["foooo", "bar", "baz"], ids=["A0", "A1", "A2"]), strings(spark, ["foooo", "dooz", "bar", "baz", "foooob"], ids=["B0", "B1", "B2", "B3", "B4"]), topn_side="right")
    assert by_pos(got, "most_similar_id") == ["A0", "B1", "A1", "A2", "A0"]
    assert by_pos(got, "most_similar_s") == ["foooo", "dooz", "bar", "baz", "foooo"]
    assert got.columns == ["pos", "most_similar_index", "most_similar_id", "most_similar_s"]
    forced = match_most_similar(strings(spark, ["foooo", "bar", "baz"]), strings(spark, ["foooo", "bar", "baz", "foooob"]), min_similarity=0.7)
    assert by_pos(forced, "most_similar_s") == ["foooo", "bar", "baz", "foooob"]
    method = MatchSession(strings(spark, ["a"])).match_most_similar(strings(spark, ["foooo", "bar", "foooo"], ids=[0, 1, 2]), strings(spark, ["foooo", "bar", "baz", "foooob"], ids=[100, 101, 102, 103]))
    assert by_pos(method, "most_similar_id") == [0, 1, 102, 0]
    filled = MatchSession(strings(spark, ["foooo", "bar"]), strings(spark, ["foooo", "baz"]), replace_na=True).fit().get_groups()
    assert by_pos(filled, "most_similar_index") == [0, 1]


def test_grams(spark):
    s = MatchSession(strings(spark, ["x"]))
    assert s.n_grams("McDonalds") == ["mcd", "cdo", "don", "ona", "nal", "ald", "lds"]
    assert s.n_grams("ÀbracâDABRÀ") == ["abr", "bra", "rac", "aca", "cad", "ada", "dab", "abr", "bra"]
    assert s.n_grams("a-b") == []
    assert MatchSession(strings(spark, ["x"]), ignore_case=False).n_grams("McDonalds")[:2] == ["McD", "cDo"]


def test_corrections(spark):
    s = MatchSession(strings(spark, ["microsoftoffice 365 home", "microsoftoffice 365 pers", "microsoft office"]), min_similarity=0.8).fit()
    s.add_match("microsoftoffice 365 home", "microsoft office").add_match("microsoftoffice 365 pers", "microsoft office")
    assert len(set(by_pos(s.get_groups(), "group_rep_s"))) == 1
    s = MatchSession(strings(spark, ["foooo", "no match", "baz", "foooob"]), min_similarity=0.7).fit()
    assert (0, 3) in pairs(s)
    s.remove_match("foooo", "foooob")
    assert not {(0, 3), (3, 0)} & set(pairs(s))
    with pytest.raises(ValueError):
        s.add_match("foooo", "nothing")


def test_errors(spark):
    with pytest.raises(NotFittedError):
        MatchSession(strings(spark, ["a"])).get_matches()
    for bad in ({"group_rep": "last"}, {"tfidf_matrix_dtype": "int"}, {"n_blocks": (0, 1)}, {"replace_na": True}):
        with pytest.raises(ValueError):
            MatchSession(strings(spark, ["a"]), **bad)
    with pytest.raises(TypeError):
        MatchSession(strings(spark, ["a"]), nothing=1)
    with pytest.raises(ValueError):
        MatchSession(strings(spark, ["a"], ids=["x"]), strings(spark, ["a"]))
    with pytest.raises(TypeError):
        MatchSession(Strings(spark.createDataFrame([(0, 1)], "pos long, s long"), "s", key="pos")).fit()
    with pytest.raises(Exception, match="null string"):
        MatchSession(strings(spark, ["a", None])).fit()


def brute(values, t):
    grams = [[v.lower()[i : i + 3] for i in range(len(v) - 2)] for v in values]
    n, vocabulary = len(values), {g for x in grams for g in x}
    idf = {g: math.log((1 + n) / (1 + sum(g in x for x in grams))) + 1 for g in vocabulary}
    vecs = []
    for x in grams:
        w = {g: x.count(g) * idf[g] for g in x}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1
        vecs.append({g: v / norm for g, v in w.items()})
    return {(i, j): s for i, j in combinations(range(n), 2) if (s := sum(v * vecs[j].get(g, 0) for g, v in vecs[i].items())) > t}


def test_prefix_filter_equals_all_pairs(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(60)]
    for t in (0.3, 0.7):
        got = {k: v for k, v in pairs(MatchSession(strings(spark, words), min_similarity=t, max_n_matches=1000).fit()).items() if k[0] < k[1]}
        want = brute(words, t)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("deep", [False, True])
def test_keys_of_shared_grams_equal_products(spark, monkeypatch, deep):
    from quillmatch.operators import matching, shared_grams

    r = random.Random(7)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(50)]
    cases = [dict(min_similarity=0.3, max_n_matches=3, force_symmetries=False), dict(min_similarity=0.7, max_n_matches=1000), dict(min_similarity=0.3, max_n_matches=2, topn_side="right")]

    def results():
        sides = [(words, None), (words, None), (words[:30], words[20:])]
        return [pairs(MatchSession(strings(spark, a), b and strings(spark, b), **o).fit()) for (a, b), o in list(zip(sides, cases))[deep:]]

    want = results()
    monkeypatch.setattr(matching, "MUCH", -1)
    monkeypatch.setattr(matching, "STEPS", () if deep else (0.6,))
    if deep:  # keys of several grams, dealt out
        monkeypatch.setattr(shared_grams, "WORTH", 0)
        monkeypatch.setattr(shared_grams, "GAIN", 1e9)
        monkeypatch.setattr(shared_grams, "DEPTH", 2)
        monkeypatch.setattr(shared_grams, "DEALT", 3)
    for got, expected in zip(results(), want):
        assert got == pytest.approx(expected)


@pytest.mark.parametrize("small", [False, True])
def test_blocks_equal_products(spark, monkeypatch, small):
    from quillmatch.operators import blocks, matching

    r = random.Random(11)
    words = ["".join(r.choice("aaabbc") for _ in range(r.randint(1, 12))) for _ in range(60)]
    cases = [dict(min_similarity=0.3, max_n_matches=3, force_symmetries=False), dict(min_similarity=0.6, max_n_matches=1000), dict(min_similarity=0.3, max_n_matches=1), dict(min_similarity=0.3, max_n_matches=2, topn_side="right")]
    sides = [(words, None), (words, None), (words[:40], words[20:]), (words[:40], words[20:])]

    def results():
        return [pairs(MatchSession(strings(spark, a), b and strings(spark, b), **o).fit()) for (a, b), o in zip(sides, cases)]

    want = results()
    monkeypatch.setattr(matching, "FEW", -1)
    monkeypatch.setattr(matching, "best_by_steps", None)  # nor thresholds in steps, with their many jobs
    if small:  # many blocks, and a few products at a time
        monkeypatch.setattr(blocks, "BLOCK", 60)
        monkeypatch.setattr(blocks, "TASKS", 1)
    for got, expected in zip(results(), want):
        assert got == pytest.approx(expected)


@pytest.mark.parametrize("rare", [0, 1 / 8, 1])
def test_a_block_against_brute_force(monkeypatch, rare):
    import numpy as np
    import pyarrow as pa

    from quillmatch.operators import blocks

    r = np.random.default_rng(3)

    def table(begin, n):
        rows = [sorted({int(r.random() ** 3 * 40) for _ in range(r.integers(1, 10))}) for _ in range(n)]
        weights = [w / np.linalg.norm(w) for w in (r.random(len(g)) + 0.1 for g in rows)]
        return pa.table({"f": range(begin, begin + n), "g": pa.array(rows, pa.list_(pa.int64())), "w": pa.array(weights, pa.list_(pa.float64()))})

    def dense(table):
        out = np.zeros((table.num_rows, 40))
        for k, (g, w) in enumerate(zip(table["g"].to_pylist(), table["w"].to_pylist())):
            out[k, g] = w
        return out

    monkeypatch.setattr(blocks, "RARE", rare)
    near, far = table(0, 50), table(30, 60)
    every = dense(near) @ dense(far).T
    for small in (False, True):
        if small:
            for name, n in (("PRODUCTS", 30), ("CELLS", 150), ("PAIRS", 5)):
                monkeypatch.setattr(blocks, name, n)
        for t in (0.05, 0.4, 0.8):
            for n in (1, 4, 1000):
                want = set()
                for x in range(50):
                    over = sorted(((s, y + 30) for y, s in enumerate(every[x]) if s > t and y + 30 != x), reverse=True)
                    want |= {(x, y) for s, y in over if s >= over[min(n, len(over)) - 1][0] - 1e-8}
                got = blocks.best_of_blocks(near, far, t, n).to_pylist()
                assert {(p["near"], p["far"]) for p in got} == want and len(got) == len(want)
                assert all(p["similarity"] == pytest.approx(every[p["near"], p["far"] - 30]) for p in got)


def test_vectors_settled_by_couples_of_rare_grams_meet_little(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quillmatch.operators import blocks

    r, spans = np.random.default_rng(5), blocks._spans

    texts = [[f"#{x:09d}" for x in r.choice(most, n, False)] for n, most in ((500, 900_000), (15_000, 60_000))]
    grams = [[sorted({int(x[i : i + 3].replace("#", "1")) + 900 * (x[i] == "#") for i in range(8)}) for x in side] for side in texts]
    df = np.bincount([g for side in grams for row in side for g in row], minlength=1001)

    def table(begin, rows):
        weights = [w / np.linalg.norm(w) for w in (np.log(15_501 / (1 + df[row])) + 1 for row in rows)]
        return pa.table({"f": range(begin, begin + len(rows)), "g": pa.array(rows, pa.list_(pa.int64())), "w": pa.array(weights, pa.list_(pa.float64()))})

    near, far = table(0, grams[0]), table(10_000, grams[1])
    x, y = (np.zeros((t.num_rows, 1001)) for t in (near, far))
    for out, t in ((x, near), (y, far)):
        for k, (g, w) in enumerate(zip(t["g"].to_pylist(), t["w"].to_pylist())):
            out[k, g] = w
    every = x @ y.T
    for n in (1, 3):
        met = []
        monkeypatch.setattr(blocks, "_spans", lambda begins, lengths: met.append(int(lengths.sum())) or spans(begins, lengths))
        got = blocks.best_of_blocks(near, far, 0.3, n).to_pylist()
        last = np.maximum(np.sort(every, 1)[:, -n] - 1e-8, 0.3)
        assert {(p["near"], p["far"] - 10_000) for p in got} == {(int(a), int(b)) for a, b in zip(*np.nonzero(every >= last[:, None]))}
        assert n > 1 or sum(met) < 120_000


@pytest.mark.parametrize("frozen", [False, True])
def test_vectors_as_arrays_equal_postings(spark, frozen):
    from quillmatch.config import MatchOptions
    from quillmatch.operators import vectors

    options = MatchOptions()
    one, two = (spark.createDataFrame([(w, w) for w in words], "form string, form_text string") for words in (["abcabcd", "abcabcd", "xyzu", "ab", "", "unlike"], ["abcd", "zabc", "xyz", "xyzu"]))
    counts, n = vectors.counts_of(one if frozen else one.unionByName(two), options)
    corpus = vectors.corpus(counts, n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # several lists of grams
        got = vectors.vectors_of(one, two, corpus if frozen else None, options)
        counts, _ = vectors.counts_of(one.unionByName(two), options)
        want = {(r.form, r.gram): (r.df, r.w) for r in vectors.vectors(counts, corpus, options).collect()}
        names = {r.number: r.form for r in got.numbers.collect()}
        grams = {form: set() for form in names.values()}
        for p in got.postings("l").collect():
            grams[names[p.form]].add((p.df, round(p.w, 9)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    shared = {g for f, g in want if f in ("abcabcd", "xyzu", "unlike")} & {g for f, g in want if f in ("abcd", "zabc", "xyz", "xyzu")}
    for form in ("abcabcd", "xyzu", "unlike", "ab", ""):
        assert grams[form] == {(d, round(w, 9)) for (f, g), (d, w) in want.items() if f == form and g in shared}
    assert {names[r.f] for r in got.table.collect()} == {f for f, _ in want}


def test_a_nearest_match_takes_few_jobs(spark, monkeypatch):
    from quillmatch.operators import matching

    monkeypatch.setattr(matching, "FEW", -1)
    spark.sparkContext.setJobGroup("nearest", "nearest")
    try:
        assert match_most_similar(strings(spark, NAMES), strings(spark, NAMES[::-1]), min_similarity=0.3).count() == 6
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 55


def test_copies_are_dealt_out_before_they_are_put_together(spark, monkeypatch):
    from quillmatch.operators import matching

    monkeypatch.setattr(matching, "MATCHES", 100)
    s = MatchSession(strings(spark, ["foo"] * 300 + ["food", "bar"]), max_n_matches=3).fit()
    got = pairs(s)
    assert got.keys() == {(i, i) for i in range(302)} | {p for i in range(300) for j in range(3) for p in ((i, j), (j, i))} and set(got.values()) == {1.0}
    matches, total = matching.best_n(s._pairs, s._left, s._right, s.options)
    assert total == matches.count() == 902
    plan = matching.symmetric(matches, total, s._left)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    moved = plan.index("Exchange hashpartitioning(left_pos")
    assert "Aggregate" in plan[:moved] and "Aggregate" not in plan[moved:]


def test_grams_are_made_in_tasks_of_bounded_text(spark, monkeypatch):
    from quillmatch.config import MatchOptions
    from quillmatch.operators import vectors

    monkeypatch.setattr(vectors, "CHARACTERS", 100)
    rows = spark.createDataFrame([(f"{i:010d}",) for i in range(90)], "form string")
    counts, n = vectors.counts_of(rows, MatchOptions())
    assert n == 90 and counts.rdd.getNumPartitions() == 9 and counts.agg({"tf": "sum"}).first()[0] == 90 * 8


def test_positions_follow_the_order(spark):
    df = spark.createDataFrame([(9, "foo"), (1, "bar"), (5, "foo")], "k long, s string").repartition(3)
    got = match_strings(Strings(df, "s", order_by=("k",)))
    assert {(r.left_index, r.right_index) for r in got.collect()} == {(0, 0), (1, 1), (1, 2), (2, 1), (2, 2)}


@pytest.mark.parametrize("partitions", [2, 211])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = pairs(MatchSession(strings(spark, NAMES), min_similarity=0.3).fit())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert pairs(MatchSession(strings(spark, NAMES), min_similarity=0.3).fit()) == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ties_at_the_last_match_go_by_position(spark):
    s = MatchSession(strings(spark, ["abcd", "abcx", "abcy", "abcz", "abcx"]), min_similarity=0.1, max_n_matches=2, force_symmetries=False).fit()
    assert {k for k in pairs(s) if k[0] == 0} == {(0, 0), (0, 1)} or {k for k in pairs(s) if k[0] == 0} == {(0, 0), (0, 2)}
    assert all(sum(k[0] == i for k in pairs(s)) == 2 for i in range(5))


def test_dates_in_many_formats(spark):
    from quillmatch.operators import representatives

    assert representatives.is_date("Jan 5 2014") and representatives.is_date("2014-01-05") and not representatives.is_date("no date")
    rows = [(1, "a", "Jan 5 2014"), (2, "a", "2013-12-31"), (3, "b", "5.3.2015 10:00"), (4, "b", None), (5, "c", None)]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    got = representatives.new_group_rep_by_earliest_timestamp(df, "g", "id", "t", order_by="id")
    assert {r.id: r.group_rep_id for r in got.collect()} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 5}
    with pytest.raises(Exception, match="not a date"):
        representatives.new_group_rep_by_earliest_timestamp(spark.createDataFrame([(1, "a", "nonsense")], df.schema), "g", "id", "t", order_by="id").collect()


def test_frozen_weights_are_learned_anew_for_other_grams(spark):
    s = MatchSession(strings(spark, NAMES), corpus="frozen").fit()
    s.update_options(ngram_size=2, min_similarity=0.6)
    want = pairs(MatchSession(strings(spark, NAMES), ngram_size=2, min_similarity=0.6).fit())
    assert pairs(s.fit()) == pytest.approx(want) and any(a != b for a, b in want)


def test_stream_does_not_depend_on_batches(spark, tmp_path):
    from quillmatch.streaming.incremental import match_stream

    masters = spark.createDataFrame([(i, s) for i, s in enumerate(["alpha company", "beta corporation", "gamma limited"])], "k long, s string")
    master = Strings(masters, "s", key="k")
    new = [(10, "alpha companies"), (11, "beta corporations"), (12, "unlike")]
    for row in new:
        spark.createDataFrame([row], "k long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    writer = match_stream(stream, "t", master, lambda pairs, number: got.extend((r.left_s, round(r.similarity, 9), r.right_t) for r in pairs.collect()), min_similarity=0.4)
    writer.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    whole = MatchSession(master, corpus="frozen", min_similarity=0.4).learn().match_strings(master, Strings(spark.createDataFrame(new, "k long, t string"), "t", key="k"))
    assert sorted(got) == sorted((r.left_s, round(r.similarity, 9), r.right_t) for r in whole.collect())
    assert {(a, b) for a, _, b in got} == {("alpha company", "alpha companies"), ("beta corporation", "beta corporations")}


def test_components_leave_one_table_of_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    got = {(r.node, r.component) for r in components(spark.range(40).selectExpr("id a", "id + 1 b")).collect()}
    assert got == {(n, 0) for n in range(41)}
    assert len(list(tmp_path.glob("*/links-*"))) == 1


def test_a_folder_where_none_is_set():
    class Context:
        master = "local[1]"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    assert shared.shared_folder(Session) == shared.shared_folder(Session)
