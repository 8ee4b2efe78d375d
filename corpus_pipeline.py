"""The corpus pipeline: five stages over ``documents``, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run`` writes each stage's result to
the folder that the cluster shares and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm import decontamination, language, near_dedup, pieces, pii
from quillmatch.operators.skew import fresh
from quillmatch.shared import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Null texts, empty ones and texts without a letter go, and so do ambiguous ones; copies share their fate. Where no row has a lang all go. An empty table stays empty; extra
    columns stay as they are, whatever their names."""
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id (null last).

    Null and empty texts are copies of each other; of rows equal in doc_id and text one stays. An empty table stays empty; extra columns stay as they are."""
    return near_dedup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts stay, copies share their fate, an empty table stays empty; without items all documents stay. Extra columns stay as they are."""
    return decontamination.clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind. n_chars counts the new text.

    A null text stays null and keeps its n_chars; rows and all other columns, whatever their names, stay as they are."""
    [masked] = fresh(docs.columns, "masked")
    found = pii.find_pii(docs, "text", spans=None, masked=masked)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(masked))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length(masked)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source (if there), n_tokens and digests of the piece ids and of what they decode to, for every row.

    A null text counts as empty: the end id alone. Other columns aren't read."""
    import public_tokenizers

    columns = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    return pieces.piece_digests(docs.select(*columns), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", mask_pii),
    ("pieces", encode),
]

#: The stages' decisions (learned weights, sketches, walks, check digits, merges) aren't in SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
