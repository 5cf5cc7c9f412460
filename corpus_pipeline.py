"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before it kept, as a table, and returns the columns of
``documents``; the last returns the pieces of the packed sequences. Empty tables, null texts
and further columns pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import exact_dedup, packing, quality, simhash_wide, suffix_dedup
from folioframe.llm.queries import ship
from folioframe.session import drop_tables, scratch_path, scratch_tables

# Bytes of a passage that repeats: fifty words and more of ordinary text are longer.
PASSAGE = 200

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_held: list[str] = []  # tables that earlier stages made on their way


def stage(function: Stage) -> Stage:
    """A stage that first deletes what earlier stages made and ``docs`` does not read."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        read = docs.inputFiles()
        done = [path for path in _held if not any(path.rpartition("/")[2] in file for file in read)]
        drop_tables(spark, done)
        with scratch_tables() as made:
            out = function(spark, docs, sf_dir)
        _held[:] = [path for path in _held if path not in done] + made
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain word rules and the fertility bands."""
    return quality.keep(docs, public_tokenizers.path("piece_bpe_32k.model"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the largest doc_id."""
    return exact_dedup.drop_copies(docs, largest=True)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a similarity of 0.8 or more."""
    return simhash_wide.one_of_each(docs, words=5)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or place, already has."""
    return suffix_dedup.strip_repeats(docs, length=PASSAGE, keep="first")


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2,048 ids."""
    return packing.pack(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

# The stages use tokenizer files and wide fingerprints; a brute-force version is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
