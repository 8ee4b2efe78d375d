"""Secret scans through an incremental blob ledger, with DataFrame functions only.

Method: every version of a text is addressed by its content (SHA-256). A ledger has one row per blob and rule version that
was scanned, with the findings. Only pairs of blob and rule version that the ledger lacks are scanned, each distinct blob
once, however many paths have it; findings are joined back to all paths.

Shape: blobs are counted and held against the ledger by address alone. A text whose blob is neither in the ledger nor in another row is scanned where it is read; texts
travel only for blobs of several rows, once per map task, and for blobs with new rules. Bit filters of bounded size tell the rows apart, and exact joins follow them. Findings are
joined back to the rows that may have some, with the rows of a very frequent blob dealt out.

Positions without Python: a rule's matches (``regexp_extract_all``) and the text between them (``split``) alternate, so the
running sum of their lengths in code points gives each start. It is summed by blocks of ``BLOCK``, so a text of very many matches takes no square of their number.

Cases: null text counts as empty (no findings); repeated rows and copies each get their row; empty tables give empty results;
extra columns of the input are ignored by ``scan`` but for the named ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.llm.rows import maybe_among
from quillmatch.operators.skew import fresh, join_unique
from quillmatch.shared import written

# The rules as kind, version, expression, group whose length counts, least length of it: fixed values. Expressions for hex and
# access state the least length themselves, which finds the same runs: a match of these always takes a whole run.
RULES = (
    ("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
KINDS = tuple(r[0] for r in RULES)
BLOCK = 128
SPAN = "array<struct<start: int, kind: int, `end`: int>>"
LEDGER = f"blob string, kind string, version int, spans {SPAN}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body has it."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """The sum of an array of ints up to each of its elements, by blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def of_blocks(a, sums):
        before = lambda b: total(F.slice(sums, F.lit(1), b))
        inside = lambda b: let(F.slice(a, b * BLOCK + 1, BLOCK), lambda own: let(before(b), lambda base: F.transform(own, lambda x, i: base + total(F.slice(own, F.lit(1), i + 1)))))
        return F.flatten(F.transform(every(F.size(sums)), inside))

    blocks = lambda a: F.transform(every(F.ceil(F.size(a) / BLOCK).cast("int")), lambda b: total(F.slice(a, b * BLOCK + 1, BLOCK)))
    return let(numbers, lambda a: let(blocks(a), lambda sums: of_blocks(a, sums)))


def spans_of(text: Column, kind: int, expression: str, group: int, least: int) -> Column:
    """Array of (start, kind, end) of the matches that hold; texts without a match are never split."""
    rule, none = F.lit(expression), F.expr(f"cast(array() as {SPAN})")
    lengths = lambda c: F.transform(c, F.length)
    whole, between = lengths(F.regexp_extract_all(text, rule, F.lit(0))), lengths(F.split(text, expression, -1))
    part = lengths(F.regexp_extract_all(text, rule, F.lit(group))) if group else whole
    entries = F.filter(F.arrays_zip(between.alias("gap"), whole.alias("size"), part.alias("own")), lambda x: x["size"].isNotNull())  # the last gap has no match after it

    def spans(found):
        ends = running_sums(F.transform(found, lambda x: x["gap"] + x["size"]))
        all_ = F.zip_with(found, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["own"].alias("own")))
        return F.transform(F.filter(all_, lambda x: x["own"] >= least), lambda x: x.dropFields("own"))

    return F.when(text.rlike(expression), let(entries, spans)).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def of_rules(rules) -> Column:
    return reduce(Column.__or__, [(F.col("kind") == k) & (F.col("version") == v) for k, v, *_ in rules])


def scanned(blobs: DataFrame, rules, done: bool) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, and with ``done`` the kinds that need no scan)."""
    rows = []
    for n, (kind, version, expression, group, least) in enumerate(rules):
        row = F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), spans_of(F.coalesce("text", F.lit("")), n, expression, group, least).alias("spans"))
        rows.append(F.when(~F.array_contains("done", kind), row) if done else row)
    return blobs.select("blob", F.explode(F.array(*rows)).alias("r")).where("r is not null").select("blob", "r.kind", "r.version", "r.spans")


def scan_new(texts: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` lacks. ``texts`` has columns blob and text; the ledger should be a written table."""
    seen = ledger.where(of_rules(rules)).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    counts = texts.groupBy("blob").agg(F.count("*").alias("n")).join(seen, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    counts = written(counts, "counts")
    # the blobs that aren't simply new and in one row; with what the filter takes for such, these are the ones to look up
    known = written(counts.where((F.col("n") > 1) | (F.size("done") > 0)).select("blob"), "known")
    todo = written(maybe_among(counts, F.col("blob"), known, "known").where(F.col("known") & (F.size("done") < len(rules))).select("blob", "done"), "todo")
    marked = maybe_among(texts.select("blob", "text"), F.col("blob"), known, "known")
    here = scanned(marked.where("not known").select("blob", "text"), rules, False)
    wanted = maybe_among(marked.where("known").select("blob", "text"), F.col("blob"), todo.select("blob"), "wanted").where("wanted")
    gathered = wanted.groupBy("blob").agg(F.first("text").alias("text")).join(todo.hint("merge"), "blob")
    return here.unionByName(scanned(gathered, rules, True))


def scan(df: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, new): for every row of ``df`` its ``path``, blob and all spans of the rules by start and kind; and the rows to append to the ledger, a written table.

    Without a ledger nothing has been seen yet.
    """
    versions = df.select(F.col(f"`{path}`"), blob_of(F.col(f"`{text}`")).alias("blob"), F.col(f"`{text}`").alias("text"))
    if ledger is None:
        ledger = df.sparkSession.createDataFrame([], LEDGER)
    new = written(scan_new(versions.select("blob", "text"), ledger, rules), "ledger")
    return join_back(versions.select(f"`{path}`", "blob"), ledger.select("blob", "kind", "version", "spans").unionByName(new), rules), new


def join_back(paths: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """Findings of the ledger's blobs for all paths; a blob without findings has an empty array."""
    found = written(ledger.where(of_rules(rules) & (F.size("spans") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "found")
    [maybe] = fresh([*paths.columns, "spans"], "maybe")
    marked = maybe_among(paths, F.col("blob"), found.select("blob"), maybe)
    none = F.expr(f"cast(array() as {SPAN})")
    with_some = marked.where(maybe).drop(maybe)
    counted = written(found.join(with_some.groupBy("blob").agg(F.count("*").alias("n")).hint("merge"), "blob"), "counted")
    joined = join_unique(with_some, counted, "blob", "n", "left").drop("n").withColumn("spans", F.coalesce("spans", none))
    return marked.where(~F.col(maybe)).drop(maybe).withColumn("spans", none).unionByName(joined)


def op6(spark, sf_dir: str) -> DataFrame:
    found, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ledger=written(spark.createDataFrame([], LEDGER), "ledger"))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    of_kind = lambda n: F.filter("spans", lambda s: s["kind"] == n)
    counts = [F.size(of_kind(n)).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


_RULE = {k: e.replace("'", "''").replace(r"\x20", " ") for k, _, e, _, _ in RULES}


def _sql_spans(n: int, kind: str, group: int, least: int) -> str:
    rule = _RULE[kind]
    return f"""
    SELECT id, unnest(spans) AS s FROM (
      SELECT id, [{{'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0),
                   'kind': {n}, 'size': length(hits[i]), 'own': length(parts[i])}} FOR i IN range(1, len(hits) + 1)] AS spans FROM (
        SELECT id, string_split_regex(text, '{rule}') AS gaps, regexp_extract_all(text, '{rule}', 0) AS hits, regexp_extract_all(text, '{rule}', {group}) AS parts
        FROM d WHERE regexp_matches(text, '{rule}'))
    )"""


ORACLE_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_spans(n, k, g, least) for n, (k, _, _, g, least) in enumerate(RULES))}),
f AS (SELECT id, s.start::BIGINT AS a, s.kind AS k, (s.start + s.size)::BIGINT AS z FROM m
      WHERE s.own >= CASE s.kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
g AS (SELECT id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
      string_agg(['assign', 'access', 'hex'][k + 1] || ':' || a || ':' || z, ',' ORDER BY a, k) AS spans FROM f GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (id)
"""
