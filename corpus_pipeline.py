"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret masking, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. docs must have doc_id and text; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import bpe_lexicon, decontaminate, language_id, ngram_join, secret_scan
from skarn.llm.common import materialize
from skarn.llm.queries import table, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language can be told of: null text, and text without a letter.

    lang is replaced by the language predicted; profiles are fitted on the labels of docs. Extra columns stay.
    """
    profiles = language_id.fit_profiles(docs)
    found = language_id.predict_language(docs, profiles, "__skarn_lang", "__skarn_score")
    found = found.where(F.col("__skarn_lang") != language_id.UNKNOWN)
    return found.withColumn("lang", F.col("__skarn_lang")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of documents linked by Jaccard 0.8 of five-word shingles the one of smallest doc_id."""
    return ngram_join.keep_one(docs, 5, 80, 100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of benchmark, up to a fifth of its characters edited."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [SECRET]; n_chars follows. Documents without any are unchanged."""
    return secret_scan.mask_secrets(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens): token ids of every text."""
    path = tokenizer_file("byte_bpe_50k.json")
    return bpe_lexicon.encode_documents(docs, path, bpe_lexicon.build_lexicon(docs, path))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", mask_secrets),
    ("BPE encoding", encode_tokens),
]

#: SQL can express neither profiles nor tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
