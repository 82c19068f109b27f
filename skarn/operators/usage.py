"""Token usage, run statistics, and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What cached tokens cost, as shares of the input rate.
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, calls, four token sums, cost_usd): null cost for a model without a price.

    usage: model, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens (null counts as 0);
    prices: model, in_rate, out_rate per million tokens.
    """
    names = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    sums = usage.groupBy("model").agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in names])
    out = sums.join(prices, "model", "left")
    billable = F.col("input_tokens") + F.col("cache_read_tokens") * CACHE_READ + F.col("cache_creation_tokens") * CACHE_WRITE
    return out.withColumn("cost_usd", (billable * F.col("in_rate") + F.col("output_tokens") * F.col("out_rate")) / 1e6).drop("in_rate", "out_rate")


def run_stats(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a run: cached, generated, failed, truncated, refused, and token sums.

    predictions: status (cached, generated or failed), stop_reason, input_tokens, output_tokens.
    """
    return predictions.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("cached", "generated", "failed")],
        F.count_if(F.col("stop_reason").isin("max_tokens", "length")).alias("truncated"),
        F.count_if(F.col("stop_reason") == "refusal").alias("refused"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )


def run_cost(stats: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """stats with cost_usd; null where no token was counted."""
    known = (F.col("input_tokens") != 0) | (F.col("output_tokens") != 0)
    return stats.withColumn("cost_usd", F.when(known, F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out))
