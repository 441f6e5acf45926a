"""A training-data pipeline over ``documents``: toxic documents go, of near-duplicates one stays,
passages that repeat are cut, documents that hold test items go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in
the shared folder and reads it again for the next, so a lost executor costs no more than the tasks
of one stage. All stages but the last keep the columns of ``documents``. A row goes by its own text:
rows that share a doc_id, or have none, do not stand for each other; null texts pass all filters as empty ones, an empty table passes as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from latewise.llm import bpe, decontam, simhash, suffix, toxicity
from latewise.llm.common import staged

#: The tokenizer file of the last stage.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of a repeated string that is cut.
REPEAT_BYTES = 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not call toxic."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that also start earlier; a text of which nothing stays goes."""
    return suffix.without_repeats(docs, REPEAT_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of ids and decoded text."""
    encoded = bpe.encode(docs, TOKENIZER)
    return bpe.digests(encoded, "ids")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("suffix_dedup", cut_repeats),
          ("decontamination", drop_contaminated), ("bpe", encode)]

#: Hash functions and compressors have no SQL; tests/llm compares the rows with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
