"""The corpus pipeline: stages that turn `documents` into sequences to train on. Part of lorevane.llm.

Every stage but the last gives the columns of its input, whatever else they are called, and leaves them as they are but for
`text`. All stages take nulls in any column and read very long texts whole. An empty table stays empty.

1. quality_rules: a null, empty or blank text has no words and goes. Repeated rows are judged alike.
2. near_duplicates: null and blank texts are copies of each other. Of equal rows, and of rows with one id and text, one
   stays; rows that share an id or have none are told apart by their texts. Ties go to the smallest id, nulls last.
   Documents are near copies as operator 5 says: fingerprints of four-word shingles at 4 or fewer differing bits, directly
   or by others.
3. repeated_strings: every occurrence goes, those in repeated rows too; a null text stays null. A character that a cut
   divides goes as a whole, and n_chars, where there is one, is counted again.
4. benchmark_passages: a null text has no words and stays null; rows with a null id are cleaned like others.
5. sequences: a null text is the end id alone; rows with one id are packed each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorevane.llm import decontam, packing, rules, simhash, suffix_dedup
from lorevane.llm.common import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of operator 9 keep."""
    return rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: the one with the smallest id."""
    return simhash.keep_one(docs)


#: A passage of over 50 words: 51 words of three letters and a space fill 204 bytes.
REPEATED_BYTES = 200


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEATED_BYTES bytes that start more than once, so without passages of over 50
    words that repeat. Operator 3's own query looks for strings of 400 bytes, as its contract says."""
    return suffix_dedup.clean(docs, REPEATED_BYTES)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's phrases of ten words."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 1024 tokens."""
    return packing.digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", sequences),
]

#: Fingerprints, byte strings and tokens are not expressible in DuckDB's SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
