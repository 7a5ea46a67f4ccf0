"""A training-data pipeline of five stages: STAGES, run() and the query `pipeline`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results of every stage: an empty table gives no rows; null and empty texts are documents without words, which are
near copies of one another, so one of them stays; null doc_ids, langs and sources are kept as they are; texts of any length
are taken whole; repeated rows are exact copies; extra columns, whatever their names, go with their rows up to packing,
which drops them (values of columns `copy` and `shuffle_key` become those of mixing).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, secrets, simhash, toxicity
from tidemark.llm.common import table
from tidemark.llm.queries import tokenizer_path
from tidemark.session import importable, stored


#: Rows that cross to a Python worker at once: whole texts, which the engine and the worker both hold outside the heap.
ROWS_AT_ONCE = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most ROWS_AT_ONCE rows an Arrow batch, or what the session asks for if that is less. The rows are the same."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(ROWS_AT_ONCE if int(before) <= 0 else min(ROWS_AT_ONCE, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches the threshold go; the model is trained on labels outside the held-out fold. Without labels of both kinds all rows stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays, by five-word shingles with a Jaccard similarity of 0.8 or more: that of the smallest doc_id."""
    importable(spark)
    with small_batches(spark):  # what crosses to Python here is stored within
        return simhash.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; found secrets are masked, and n_chars follows. A null text stays null, and so does its n_chars."""
    importable(spark)
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in masked.columns else masked


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out to meet the target weights of sources, in a new global order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, sequences and offsets: the training data. Pieces of one copy of a document share `row`."""
    importable(spark)
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_to_weights),
    ("packing", pack_sequences),
]

#: Learned scores, 64-bit hashes of shingles and a tokeniser can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents; each stage's rows are stored before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
