"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bytes_bpe, licences, lines, near_duplicates, nearest, packing, personal, quality, repeats, secrets
from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed_repeats(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_data(read(spark, sf_dir, "documents"))


def op6_bytes_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytes_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(read(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_simhash, op3_repeats, op4_quality, op5_personal, op6_bytes_bpe, op7_secrets, op8_nearest, op9_lines, op10_licences)
}
ORACLES: dict[str, str] = {"op9_lines": lines.ORACLE}
