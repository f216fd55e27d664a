"""Documents through quality rules, line dedup, near-dedup, secret scans and packing.

Each stage works on all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import lines, near_duplicates, packing, quality, secrets
from weftline.llm.common import few_files, materialise, read

#: Pages of a host that a line must stand on to count as repeated; beyond, the ratio alone decides. Hosts of fewer pages keep their lines.
STAGE_PAGES = 3
#: Bytes of words that a worker of the last stage remembers: less than the operator's own, as workers of other stages are still there.
REMEMBER = 25_000_000


#: Rows of an Arrow batch: texts may be long, and a batch is held by Spark and by the Python worker at once.
BATCH_ROWS = 1000


def _short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, unless they are fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity bands."""
    _short_batches(spark)
    return few_files(quality.kept_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without their sources' boilerplate lines."""
    _short_batches(spark)
    return few_files(lines.deduplicated(docs, min_pages=STAGE_PAGES))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one of smallest doc_id.

    Candidates come from op2's fingerprints and grid join, then from MinHash bands; the exact similarity decides.
    """
    _short_batches(spark)
    return few_files(near_duplicates.one_of_each(docs, near_duplicates.similar(docs)))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with every secret replaced by a mark."""
    _short_batches(spark)
    return few_files(secrets.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows of 4096."""
    _short_batches(spark)
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), REMEMBER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packed),
]
#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
