"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; suffix sums over that histogram answer totals, quantiles
and truncated totals for every context limit. The histogram has one row for each length that occurs,
however many documents there are.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, select_as, small_batches

#: Lengths of one block of the histogram: suffix sums are taken within blocks, and over blocks.
BLOCK = 1024
QUANTILES = (50, 90, 99)  # percent
_encoders: dict = {}


def encoder(path: str, pattern: str):
    """A byte-level encoder of the ranks file at path; strings of special tokens are ordinary text."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encoded_lengths(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens of every row's whole text; 0 for null."""
    small_batches(documents.sparkSession)

    def run(batches):
        encode = encoder(path, pattern).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return select_as(documents, text="string").mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs) of the lengths that occur."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))


def answers(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: what suffix sums say.

    (context_limit, docs: of just that length, docs_longer, tokens_longer: total of these documents,
    truncated_total: tokens left if every document is cut at the limit, lost_total, total_tokens,
    total_docs, share_kept: documents that fit, quantile_p50, _p90, _p99: the smallest length that so
    large a share of documents doesn't exceed). Between two lengths that occur, truncated_total is
    linear in the limit: it rises by docs_longer for each token, so the table answers any limit.
    An empty histogram gives an empty result; documents without text count with length 0.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(whole).alias("total_docs"),
        F.sum("t").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.select(
        "n_tokens",
        "docs",
        "block",
        F.coalesce(F.sum("docs").over(within), F.lit(0)).alias("d_within"),
        F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")).over(within), F.lit(0)).alias("t_within"),
    ).join(blocks, "block")
    out = sums.select(
        F.col("n_tokens").alias("context_limit"),
        "docs",
        (F.col("d_within") + F.col("d_later")).alias("docs_longer"),
        (F.col("t_within") + F.col("t_later")).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    cut = F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("context_limit")
    out = out.withColumns({"truncated_total": cut, "lost_total": F.col("total_tokens") - cut, "share_kept": 1 - F.col("docs_longer") / F.col("total_docs")})
    # The quantile of q percent is the first length at which at most 100 - q percent of the documents are longer, in whole numbers.
    quantiles = out.agg(*[F.min(F.when(F.col("docs_longer") * 100 <= F.col("total_docs") * (100 - q), F.col("context_limit"))).alias(f"quantile_p{q}") for q in QUANTILES])
    return out.crossJoin(F.broadcast(quantiles))  # one row of three numbers


def count_tokens(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """answers() of the lengths of all whole texts; see there for empty tables and null texts.

    Repeated rows count one by one; only the column text is read, whatever others are named. The
    histogram is a table of its own, as several branches of the answers read it: texts are encoded once.
    """
    return answers(materialize(length_histogram(encoded_lengths(documents, path, pattern)), "lengths"))
