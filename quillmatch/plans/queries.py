"""Named queries over the tables of a folder, and DuckDB SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.api import compute_pairwise_similarities, group_similar_strings, match_most_similar, match_strings
from quillmatch.config import MatchOptions
from quillmatch.functions.text import ngrams, normalized
from quillmatch.operators import representatives, vectors
from quillmatch.operators.components import components
from quillmatch.session import MatchSession, Strings
from quillmatch.sources.readers import table

DEFAULTS = MatchOptions()


def similarity(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 6))


def suppliers(spark, d):
    return Strings(table(spark, d, "supplier"), "s_name", id="s_suppkey", key="s_suppkey")


def customers(spark, d):
    return Strings(table(spark, d, "customer"), "c_name", id="c_custkey", key="c_custkey")


def parts(spark, d):
    return Strings(table(spark, d, "part"), "p_name", id="p_partkey", key="p_partkey")


def of(df: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """The ids and similarities of a pair table."""
    l = next(c for c in df.columns if c.startswith("left_") and c.endswith("key"))  # noqa: E741
    r = next(c for c in df.columns if c.startswith("right_") and c.endswith("key"))
    return similarity(df.select(F.col(l).alias(left), F.col(r).alias(right), "similarity"))


def normalize_text(spark, d):
    return normalized(table(spark, d, "part"), "p_name", DEFAULTS, "form").select("p_partkey", "form")


def char_ngrams(spark, d):
    df = normalized(table(spark, d, "supplier"), "s_name", DEFAULTS, "form")
    return df.select("s_suppkey", F.posexplode(ngrams(F.col("form"), 3)).alias("at", "gram"))


def _counts(spark, d):
    rows = normalized(table(spark, d, "supplier"), "s_name", DEFAULTS, "form")
    return vectors.counts_of(rows, DEFAULTS)


def ngram_counts(spark, d):
    return _counts(spark, d)[0].select("form", "gram", "tf")


def document_frequency(spark, d):
    return vectors.document_frequencies(_counts(spark, d)[0])


def idf_weights(spark, d):
    return vectors.corpus(*_counts(spark, d)).select("gram", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark, d):
    counts, n = _counts(spark, d)
    return vectors.vectors(counts, vectors.corpus(counts, n), DEFAULTS).select("form", "gram", F.round("w", 6).alias("w"))


def pairwise_similarity(spark, d):
    df = table(spark, d, "part")
    one, two = (Strings(df, c, index=("p_partkey",), key="p_partkey") for c in ("p_name", "p_type"))
    return similarity(compute_pairwise_similarities(one, two))


def match_self(spark, d):
    return of(match_strings(customers(spark, d)))


def match_many_copies(spark, d):
    return of(match_strings(parts(spark, d)))


def match_two_inputs(spark, d):
    return of(match_strings(customers(spark, d), suppliers(spark, d), min_similarity=0.4))


def match_ignore_index(spark, d):
    got = match_strings(suppliers(spark, d), ignore_index=True)
    return similarity(got)


def match_topn(spark, d):
    return of(match_strings(suppliers(spark, d), min_similarity=0.3, max_n_matches=3, force_symmetries=False))


def match_topn_right(spark, d):
    return of(match_strings(customers(spark, d), suppliers(spark, d), min_similarity=0.3, max_n_matches=2, topn_side="right"))


def match_symmetrized(spark, d):
    return of(match_strings(suppliers(spark, d), min_similarity=0.3, max_n_matches=3))


def match_include_zeroes(spark, d):
    nations = Strings(table(spark, d, "nation"), "n_name", id="n_nationkey", key="n_nationkey")
    return of(match_strings(suppliers(spark, d), nations, min_similarity=0.0, max_n_matches=1000))


def match_case_sensitive(spark, d):
    return of(match_strings(suppliers(spark, d), ignore_case=False, min_similarity=0.8, max_n_matches=1000))


def match_ngram2(spark, d):
    return of(match_strings(suppliers(spark, d), ngram_size=2, min_similarity=0.7, max_n_matches=1000))


def match_custom_regex(spark, d):
    return of(match_strings(suppliers(spark, d), regex="[0#]", min_similarity=0.8, max_n_matches=1000))


def match_page_urls(spark, d):
    pages = Strings(table(spark, d, "pages").select(F.col("page_id").alias("pagekey"), "url"), "url", id="pagekey", key="pagekey")
    return of(match_strings(pages, min_similarity=0.7, max_n_matches=1000))


def non_exact_matches(spark, d):
    return match_self(spark, d).where("left_id <> right_id")


def duplicate_ids(spark, d):
    return non_exact_matches(spark, d).select("left_id").distinct()


def most_similar(spark, d):
    got = match_most_similar(customers(spark, d), suppliers(spark, d), min_similarity=0.3)
    return got.select(F.col("pos").alias("s_suppkey"), "most_similar_c_custkey", "most_similar_c_name")


def most_similar_right(spark, d):
    got = match_most_similar(customers(spark, d), suppliers(spark, d), min_similarity=0.3, topn_side="right", replace_na=True)
    return got.select(F.col("pos").alias("s_suppkey"), "most_similar_index", "most_similar_c_custkey", "most_similar_c_name")


def _grouped(spark, d, rep):
    got = group_similar_strings(suppliers(spark, d), min_similarity=0.8, group_rep=rep)
    return got.select(F.col("pos").alias("s_suppkey"), "group_rep_s_suppkey", "group_rep_s_name")


def group_first(spark, d):
    return _grouped(spark, d, "first")


def group_centroid(spark, d):
    return _grouped(spark, d, "centroid")


def group_sizes(spark, d):
    return _grouped(spark, d, "first").groupBy("group_rep_s_suppkey").agg(F.count("*").alias("n"))


def connected_components(spark, d):
    matches = MatchSession(customers(spark, d)).fit().match_list
    return components(matches.where("left_pos <> right_pos"), "left_pos", "right_pos")


def _corrected(spark, d):
    session = MatchSession(suppliers(spark, d), min_similarity=0.8).fit()
    names = [r.s_name for r in table(spark, d, "supplier").where("s_suppkey in (1, 2)").orderBy("s_suppkey").collect()]
    return session, names


def add_match(spark, d):
    session, (a, b) = _corrected(spark, d)
    return of(session.add_match(a, b).get_matches())


def remove_match(spark, d):
    session, (a, b) = _corrected(spark, d)
    return of(session.add_match(a, b).remove_match(a, b).get_matches())


def rep_earliest_timestamp(spark, d):
    got = representatives.new_group_rep_by_earliest_timestamp(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", order_by="o_orderkey")
    return got.select("o_orderkey", "group_rep_id", "group_rep")


def rep_highest_weight(spark, d):
    got = representatives.new_group_rep_by_highest_weight(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "c_acctbal", "c_name", order_by="c_custkey")
    return got.select("c_custkey", "group_rep_id", "group_rep")


def rep_completeness(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    got = representatives.new_group_rep_by_completeness(joined, "source", "doc_id", tested_cols=["quality", "toxic"], order_by="doc_id")
    return got.select("doc_id", "group_rep_id")


def rep_timestamp_strings(spark, d):
    orders = table(spark, d, "orders").withColumn("o_written", F.date_format("o_orderdate", "MMM d yyyy"))
    got = representatives.new_group_rep_by_earliest_timestamp(orders, "o_custkey", "o_orderkey", "o_written", "o_orderpriority", order_by="o_orderkey")
    return got.select("o_orderkey", "group_rep_id", "group_rep")


def rep_timestamp_numbers_by_place(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    got = representatives.new_group_rep_by_earliest_timestamp(orders, 0, 1, 2, order_by="o_orderkey")
    return got.select("o_orderkey", "group_rep_id")


def rep_completeness_empty(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("lang")).alias("l"))
    got = representatives.new_group_rep_by_completeness(docs, "source", "doc_id", tested_cols=["l"], order_by="doc_id")
    return got.select("doc_id", "group_rep_id")


def match_accents(spark, d):
    names = table(spark, d, "supplier").select("s_suppkey", F.translate("s_name", "uie", "\u00fc\u00ee\u00e9").alias("s_name"))
    return of(match_strings(Strings(names, "s_name", id="s_suppkey", key="s_suppkey")))


def match_tokenizer(spark, d):
    return of(match_strings(suppliers(spark, d), tokenizer=lambda c: ngrams(c, 3)))


def match_float32(spark, d):
    return of(match_strings(suppliers(spark, d), tfidf_matrix_dtype="float32")).withColumn("similarity", F.round("similarity", 4))


def match_id_is_index(spark, d):
    names = Strings(table(spark, d, "supplier"), "s_name", id="s_suppkey", index=("s_suppkey",), key="s_suppkey")
    got = match_strings(names).toDF("left_index", "left_name", "left_id", "similarity", "right_id", "right_name", "right_index")
    return similarity(got.select("left_index", "left_id", "similarity", "right_id", "right_index"))


def match_frozen_session(spark, d):
    session = MatchSession(suppliers(spark, d), corpus="frozen").fit()
    session.update_options(min_similarity=0.5, max_n_matches=1000)
    return of(session.fit().get_matches())


def match_after_reset(spark, d):
    session = MatchSession(customers(spark, d))
    session.clear_data()
    session.master = suppliers(spark, d)
    return of(session.fit().get_matches())


def most_similar_no_match(spark, d):
    got = match_most_similar(customers(spark, d), suppliers(spark, d), min_similarity=0.99, replace_na=True)
    return got.select(F.col("pos").alias("s_suppkey"), "most_similar_index", "most_similar_c_custkey", "most_similar_c_name")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, char_ngrams, ngram_counts, document_frequency, idf_weights, tfidf_vectors, pairwise_similarity, match_self, match_many_copies, match_two_inputs, match_ignore_index, match_topn,
        match_topn_right, match_symmetrized, match_include_zeroes, match_case_sensitive, match_ngram2, match_custom_regex, match_page_urls, non_exact_matches, duplicate_ids,
        most_similar, most_similar_right, group_first, group_centroid, group_sizes, connected_components, add_match, remove_match, rep_earliest_timestamp, rep_highest_weight, rep_completeness,
        rep_timestamp_strings, rep_timestamp_numbers_by_place, rep_completeness_empty, match_accents, match_tokenizer, match_float32, match_id_is_index, match_frozen_session, match_after_reset, most_similar_no_match,
    )
}

SUPPLIER, CUSTOMER, PART = "SELECT s_suppkey AS id, s_name AS s FROM supplier", "SELECT c_custkey AS id, c_name AS s FROM customer", "SELECT p_partkey AS id, p_name AS s FROM part"


def pairs_sql(left: str, right: str | None = None, t: float = 0.8, n: int = 3, lower: bool = True, regex: str = r"[,-./]|\s") -> str:
    """CTEs up to p(l, r, sim): all pairs of rows over the threshold, each row with itself and both ways in a self-join."""
    both = f"SELECT 1 AS side, id, s FROM ({left})" + (f" UNION ALL SELECT 2, id, s FROM ({right})" if right else "")
    s = "lower(s)" if lower else "s"
    other = "a.side = 1 AND b.side = 2" if right else "true"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT side, id, regexp_replace({s}, '{regex}', '', 'g') AS f FROM ({both})),
fm AS MATERIALIZED (SELECT f, count(*) AS m FROM d GROUP BY f),
tk AS MATERIALIZED (SELECT f, m, g, count(*) AS tf FROM (SELECT f, m, unnest(list_transform(range(1, length(f) - {n - 2}), lambda i: substring(f, i, {n}))) AS g FROM fm WHERE length(f) >= {n}) GROUP BY ALL),
idf AS MATERIALIZED (SELECT g, sum(m)::BIGINT AS df, ln((1.0 + (SELECT count(*) FROM d)) / (1 + sum(m))) + 1 AS idf FROM tk GROUP BY g),
w AS MATERIALIZED (SELECT f, g, tf * idf AS w FROM tk JOIN idf USING (g)),
nm AS MATERIALIZED (SELECT f, sqrt(sum(w * w)) AS nm FROM w GROUP BY f),
v AS MATERIALIZED (SELECT f, g, w / nm AS w FROM w JOIN nm USING (f)),
fp AS MATERIALIZED (SELECT a.f AS lf, b.f AS rf, CASE WHEN a.f = b.f THEN 1.0 ELSE sum(a.w * b.w) END AS sim FROM v a JOIN v b USING (g) GROUP BY a.f, b.f HAVING CASE WHEN a.f = b.f THEN 1.0 ELSE sum(a.w * b.w) END > {t}),
p AS MATERIALIZED (SELECT a.id AS l, b.id AS r, sim::DOUBLE AS sim FROM fp JOIN d a ON a.f = lf JOIN d b ON b.f = rf WHERE {other})"""


def best_sql(n: int = 20, side: str = "l") -> str:
    """... and up to k(l, r, sim): the best n of each row."""
    o = "r" if side == "l" else "l"
    return f""",
k AS MATERIALIZED (SELECT l, r, sim FROM (SELECT *, row_number() OVER (PARTITION BY {side} ORDER BY round(sim, 9) DESC, {o}) AS i FROM p) WHERE i <= {n})"""


SYMMETRIC = """,
y AS MATERIALIZED (SELECT l, r, max(sim) AS sim FROM (SELECT l, r, sim FROM k WHERE l <> r UNION ALL SELECT r, l, sim FROM k WHERE l <> r) GROUP BY l, r UNION ALL SELECT id, id, 1.0 FROM d)"""


def out(source: str, more: str = "") -> str:
    return f" SELECT l AS left_id, r AS right_id, round(sim, 6) AS similarity FROM {source} {more}"


def self_sql(strings: str, best: int = 20, **options) -> str:
    return pairs_sql(strings, **options) + best_sql(best) + SYMMETRIC


#: Components of y by spreading the least id.
GROUPS = """,
c AS (SELECT id AS x, id AS root FROM d UNION SELECT y.r, c.root FROM c JOIN y ON y.l = c.x),
g AS MATERIALIZED (SELECT x AS id, min(root) AS grp FROM c GROUP BY x)"""
SMALL = {"t": 0.8}
ADDED = """,
ab AS (SELECT (SELECT s_name FROM supplier WHERE s_suppkey = 1) AS a, (SELECT s_name FROM supplier WHERE s_suppkey = 2) AS b),
ra AS (SELECT s_suppkey AS id FROM supplier, ab WHERE s_name = a),
rb0 AS (SELECT s_suppkey AS id FROM supplier, ab WHERE s_name = b),
rb AS (SELECT id FROM rb0 UNION SELECT l FROM y WHERE r IN (SELECT id FROM rb0)),
new AS (SELECT ra.id AS l, rb.id AS r FROM ra, rb UNION SELECT rb.id, ra.id FROM ra, rb),
z AS (SELECT l, r, sim FROM y WHERE (l, r) NOT IN (SELECT (l, r) FROM new) UNION ALL SELECT l, r, 1.0 FROM new)"""
TOKENS = pairs_sql(SUPPLIER)


def _nearest(side: str) -> str:
    index = "b.l AS most_similar_index," if side == "l" else "coalesce(b.l, s_suppkey) AS most_similar_index,"
    return (
        pairs_sql(CUSTOMER, SUPPLIER, t=0.3)
        + best_sql(1, side)
        + f""",
b AS (SELECT r, l FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY round(sim, 9) DESC, l) AS i FROM k) WHERE i = 1)
SELECT s_suppkey, {index if side == "r" else ""} coalesce(c_custkey, s_suppkey) AS most_similar_c_custkey, coalesce(c_name, s_name) AS most_similar_c_name
FROM supplier LEFT JOIN b ON r = s_suppkey LEFT JOIN customer ON c_custkey = l"""
    )


EARLIEST = """SELECT o_orderkey, first_value(o_orderkey) OVER q AS group_rep_id, first_value(o_orderpriority) OVER q AS group_rep FROM orders
WINDOW q AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey)"""
ORACLE = {
    "rep_timestamp_strings": EARLIEST,
    "rep_timestamp_numbers_by_place": "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey) AS group_rep_id FROM orders",
    "rep_completeness_empty": """SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source ORDER BY (doc_id % 3 = 2 AND lang IS NOT NULL AND lang <> '')::INT DESC, doc_id) AS group_rep_id FROM documents""",
    "match_accents": self_sql(SUPPLIER) + out("y"),
    "match_tokenizer": self_sql(SUPPLIER) + out("y"),
    "match_float32": self_sql(SUPPLIER) + " SELECT l AS left_id, r AS right_id, round(sim, 4) AS similarity FROM y",
    "match_id_is_index": self_sql(SUPPLIER) + " SELECT l AS left_index, l AS left_id, round(sim, 6) AS similarity, r AS right_id, r AS right_index FROM y",
    "match_frozen_session": self_sql(SUPPLIER, 1000, t=0.5) + out("y"),
    "match_after_reset": self_sql(SUPPLIER) + out("y"),
    "most_similar_no_match": pairs_sql(CUSTOMER, SUPPLIER, t=0.99)
    + best_sql()
    + """,
b AS (SELECT r, l FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY round(sim, 9) DESC, l) AS i FROM k) WHERE i = 1)
SELECT s_suppkey, coalesce(b.l, s_suppkey) AS most_similar_index, coalesce(c_custkey, s_suppkey) AS most_similar_c_custkey, coalesce(c_name, s_name) AS most_similar_c_name
FROM supplier LEFT JOIN b ON r = s_suppkey LEFT JOIN customer ON c_custkey = l""",
    "normalize_text": r"SELECT p_partkey, regexp_replace(lower(p_name), '[,-./]|\s', '', 'g') AS form FROM part",
    "char_ngrams": r"""SELECT s_suppkey, (i - 1)::INT AS at, substring(f, i, 3) AS gram FROM (SELECT s_suppkey, f, unnest(range(1, length(f) - 1)) AS i
FROM (SELECT s_suppkey, regexp_replace(lower(s_name), '[,-./]|\s', '', 'g') AS f FROM supplier) WHERE length(f) >= 3)""",
    "ngram_counts": TOKENS + " SELECT f AS form, g AS gram, tf FROM tk",
    "document_frequency": TOKENS + " SELECT g AS gram, df FROM idf",
    "idf_weights": TOKENS + " SELECT g AS gram, round(idf, 6) AS idf FROM idf",
    "tfidf_vectors": TOKENS + " SELECT f AS form, g AS gram, round(w, 6) AS w FROM v",
    "pairwise_similarity": pairs_sql(PART, "SELECT p_partkey AS id, p_type AS s FROM part", t=0)
    + " SELECT p_partkey, round(coalesce(sim, 0), 6) AS similarity FROM part LEFT JOIN p ON l = p_partkey AND r = p_partkey",
    "match_self": self_sql(CUSTOMER) + out("y"),
    "match_many_copies": self_sql(PART) + out("y"),
    "match_two_inputs": pairs_sql(CUSTOMER, SUPPLIER, t=0.4) + best_sql() + out("k"),
    "match_ignore_index": self_sql(SUPPLIER)
    + " SELECT a.s_name AS left_s_name, l AS left_s_suppkey, round(sim, 6) AS similarity, r AS right_s_suppkey, b.s_name AS right_s_name FROM y JOIN supplier a ON a.s_suppkey = l JOIN supplier b ON b.s_suppkey = r",
    "match_topn": pairs_sql(SUPPLIER, t=0.3) + best_sql(3) + out("k"),
    "match_topn_right": pairs_sql(CUSTOMER, SUPPLIER, t=0.3) + best_sql(2, "r") + out("k"),
    "match_symmetrized": self_sql(SUPPLIER, 3, t=0.3) + out("y"),
    "match_include_zeroes": pairs_sql(SUPPLIER, "SELECT n_nationkey::BIGINT AS id, n_name AS s FROM nation", t=0)
    + " SELECT s_suppkey AS left_id, n_nationkey AS right_id, round(coalesce(sim, 0), 6) AS similarity FROM supplier CROSS JOIN nation LEFT JOIN p ON l = s_suppkey AND r = n_nationkey",
    "match_case_sensitive": self_sql(SUPPLIER, 1000, lower=False, **SMALL) + out("y"),
    "match_ngram2": self_sql(SUPPLIER, 1000, n=2, t=0.7) + out("y"),
    "match_custom_regex": self_sql(SUPPLIER, 1000, regex="[0#]", **SMALL) + out("y"),
    "match_page_urls": self_sql("SELECT page_id AS id, url AS s FROM pages", 1000, t=0.7) + out("y"),
    "non_exact_matches": self_sql(CUSTOMER) + out("y", "WHERE l <> r"),
    "duplicate_ids": self_sql(CUSTOMER) + " SELECT DISTINCT l AS left_id FROM y WHERE l <> r",
    "most_similar": _nearest("l"),
    "most_similar_right": _nearest("r"),
    "group_first": self_sql(SUPPLIER, **SMALL) + GROUPS + " SELECT id AS s_suppkey, grp AS group_rep_s_suppkey, s_name AS group_rep_s_name FROM g JOIN supplier ON s_suppkey = grp",
    "group_centroid": self_sql(SUPPLIER, **SMALL)
    + GROUPS
    + """,
wt AS (SELECT l AS id, round(sum(sim), 9) AS wt FROM y GROUP BY l),
rep AS (SELECT grp, id AS rep FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY wt DESC, id) AS i FROM g JOIN wt USING (id)) WHERE i = 1)
SELECT id AS s_suppkey, rep AS group_rep_s_suppkey, s_name AS group_rep_s_name FROM g JOIN rep USING (grp) JOIN supplier ON s_suppkey = rep""",
    "group_sizes": self_sql(SUPPLIER, **SMALL) + GROUPS + " SELECT grp AS group_rep_s_suppkey, count(*) AS n FROM g GROUP BY grp",
    "connected_components": self_sql(CUSTOMER) + GROUPS + " SELECT id AS node, grp AS component FROM g WHERE id IN (SELECT l FROM y WHERE l <> r)",
    "add_match": self_sql(SUPPLIER, **SMALL) + ADDED + out("z"),
    "remove_match": self_sql(SUPPLIER, **SMALL) + ADDED + out("z", "WHERE NOT (l IN (SELECT id FROM ra UNION SELECT id FROM rb0) AND r IN (SELECT id FROM ra UNION SELECT id FROM rb0))"),
    "rep_earliest_timestamp": EARLIEST,
    "rep_highest_weight": """SELECT c_custkey, first_value(c_custkey) OVER q AS group_rep_id, first_value(c_name) OVER q AS group_rep FROM customer
WINDOW q AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey)""",
    "rep_completeness": """SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source ORDER BY (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT DESC, doc_id) AS group_rep_id
FROM documents LEFT JOIN labels USING (doc_id)""",
}
