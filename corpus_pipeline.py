"""From documents to packed sequences: five stages, each on all that the one before kept.

Each stage gets what the one before it left as a written table, so it begins by removing the intermediate tables that
earlier stages made; any that its documents are still read from stay.
"""

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontamination, line_dedup, packing, quality_rules, simhash_golay
from sievework.llm.common import bounded_batches, materialize, release, table, taking

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_MADE: list[str] = []


def stage(function: Callable) -> Callable:
    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        release(docs, _MADE)
        with taking(_MADE):
            return function(spark, docs, sf_dir)

    return staged


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, row by row, whether or not rows share an id."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), carry=tuple(COLUMNS)).where("kept").select("carried.*")


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; n_chars follows."""
    out = line_dedup.dedup_lines(docs, **line_dedup.WHOLE)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of five-word shingles within 4 bits, or a similarity of
    0.8 between the sets of shingles."""
    return simhash_golay.keep_one(docs, shingle=5, most=4, least=0.8).select(*COLUMNS)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable]] = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", copies), ("decontamination", benchmark), ("packing", sequences)]

#: SQL has no tokenizer and no edit join by segments; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        out = function(spark, docs, sf_dir)
        with taking([] if name == STAGES[-1][0] else _MADE):  # the result stays until `common.clean_shared`
            docs = materialize(out, name)
    return docs
