"""Encoding chat examples: rendering, middle truncation, loss masks, padding, length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.tables import materialize

IGNORE, EOS, PAD = -100, 2, 0


def render_prompt(messages: Column) -> Column:
    """All turns but the assistant's, and the header that the assistant goes on from."""
    turns = F.transform(F.filter(messages, lambda m: m["role"] != "assistant"), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"]))
    return F.concat(F.array_join(turns, ""), F.lit("<|assistant|>"))


def code_points(text: Column) -> Column:
    """The built-in tokenizer: code points of text."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def truncate_middle(ids: Column, budget: Column) -> Column:
    """ids with the middle left out, so that head and tail fit the budget."""
    head = F.floor(budget / 2).cast("int")
    tail = (budget - head).cast("int")
    cut = F.concat(F.slice(ids, F.lit(1), head), F.slice(ids, F.size(ids) - tail + 1, tail))
    return F.when(F.size(ids) <= budget, ids).otherwise(cut)


def encode(rows: DataFrame, prompt: Column, completion: Column, max_len: int, eos: int | None = EOS) -> DataFrame:
    """rows with input_ids, labels, attention_mask and truncated; a target that can't fit has nulls and fits = false.

    prompt and completion are arrays of ids. The completion is never cut.
    """
    done = F.concat(completion, F.array(F.lit(eos))) if eos is not None else completion
    rows = rows.withColumns({"_p": prompt, "_c": done}).withColumn("_b", F.lit(max_len) - F.size("_c"))
    fits = F.col("_b") > 0
    rows = rows.withColumn("_t", F.when(fits, truncate_middle(F.col("_p"), F.col("_b"))))
    ids = F.concat("_t", "_c")
    return rows.withColumns(
        {
            "fits": fits,
            "truncated": F.when(fits, F.size("_p") > F.col("_b")),
            "input_ids": ids,
            "labels": F.concat(F.array_repeat(F.lit(IGNORE), F.size("_t")), F.col("_c")),
            "attention_mask": F.array_repeat(F.lit(1), F.size(ids)),
        }
    ).drop("_p", "_c", "_b", "_t")


def rejects(encoded: DataFrame, key: list[str]) -> DataFrame:
    """(key, reason) of rows whose completion leaves no room for any of the prompt."""
    return encoded.where(~F.col("fits")).select(*key, F.lit("completion_too_long").alias("reason"))


def subset(rows: DataFrame, order: list[str], limit: int | None = None, tickers: list[str] | None = None, ticker: str = "ticker") -> DataFrame:
    """rows of some companies, and of these the first limit by order; taken before anything costly is done with them."""
    if tickers is not None:
        rows = rows.where(F.col(ticker).isin([t.upper() for t in tickers]) | F.col(ticker).isin(tickers))
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def measured(rows: DataFrame, prompt: Column, completion: Column, special: int = 0) -> DataFrame:
    """rows with prompt, completion and total, their lengths in ids: special ids are added to each prompt, and one for the end to each completion."""
    return rows.withColumns({"prompt": F.size(prompt) + special, "completion": F.size(completion) + 1}).withColumn("total", F.col("prompt") + F.col("completion"))


def encoding_stats(encoded: DataFrame, by: list[str]) -> DataFrame:
    """(n, truncated, max_tokens, prompt_tokens, completion_tokens, supervised_share) of rows that fit."""
    own = F.size(F.filter("labels", lambda x: x != IGNORE))
    rows = encoded.where("fits").withColumns({"_c": own, "_n": F.size("input_ids")})
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("truncated").alias("truncated"), F.max("_n").alias("max_tokens"), F.sum(F.col("_n") - F.col("_c")).alias("prompt_tokens"), F.sum("_c").alias("completion_tokens"))
    return out.withColumn("supervised_share", F.col("completion_tokens") / F.greatest(F.lit(1), F.col("prompt_tokens") + F.col("completion_tokens")))


def pad_batches(encoded: DataFrame, order: list[str], size: int, multiple: int = 8, pad: int = PAD) -> DataFrame:
    """encoded with batch and padded arrays: to the batch's longest row, rounded up to multiple.

    Batches are runs of size rows by order. Numbering all rows in order takes one sort into ranges,
    counts by range, and their running sum, so no task gets all rows.
    """
    # Written, as its ranges are read twice: a second run might draw their bounds otherwise.
    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(encoded.repartitionByRange(parts, *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(*order)
    ranged = ranged.withColumn("_i", F.row_number().over(within))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    rows = ranged.join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_i") - 1) / size))  # a row for each partition
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    rows = rows.withColumn("_w", (F.ceil(longest / multiple) * multiple).cast("int"))
    fill = F.col("_w") - F.size("input_ids")
    rows = rows.withColumn("_f", fill)
    for c, v in (("input_ids", pad), ("labels", IGNORE), ("attention_mask", 0)):
        rows = rows.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_f"))))
    return rows.withColumn("width", F.col("_w")).drop("_part", "_i", "_before", "_w", "_f")


def length_distribution(rows: DataFrame, total: str, completion: str) -> DataFrame:
    """One row: median, p90, p99 and maximum of totals; median and maximum of completions.

    p90 and p99 are the values at place floor(q n) of the sorted totals, from 0. They are found in the
    histogram of lengths, which has a row for each length, not for each example.
    """
    sizes = rows.groupBy(F.col(total).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy(F.lit(1)))})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * F.col("n")), F.col("v")))
    tails = sizes.agg(at(0.9).alias("p90"), at(0.99).alias("p99"))
    rest = rows.agg(F.count("*").alias("n"), F.percentile(total, 0.5).alias("median"), F.max(total).alias("max"), F.percentile(completion, 0.5).alias("completion_median"), F.max(completion).alias("completion_max"), (F.sum(completion) / F.sum(total)).alias("supervised_share"))
    return rest.crossJoin(F.broadcast(tails))  # one row each


def window_fit(rows: DataFrame, total: str, completion: str, candidates: list[int]) -> DataFrame:
    """(max_len, truncated, impossible, n) for each candidate window."""
    each = F.array(*[F.lit(c) for c in candidates])
    long = rows.select(total, completion, F.explode(each).alias("max_len"))
    return long.groupBy("max_len").agg(F.count_if(F.col(total) > F.col("max_len")).alias("truncated"), F.count_if(F.col(completion) >= F.col("max_len")).alias("impossible"), F.count("*").alias("n"))


def longest(rows: DataFrame, total: str, key: list[str], n: int = 5) -> DataFrame:
    return rows.orderBy(F.desc(total), *key).limit(n)
