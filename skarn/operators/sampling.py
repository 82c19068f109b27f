"""Two-stage cluster samples, drawn by hash order: reproducible, and the same in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(seed: int, *columns: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def draw_clusters(clusters: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n clusters (all, if fewer), each with the same chance; clusters has a row for each."""
    return clusters.withColumn("_o", _order(seed, key)).orderBy("_o", key).limit(n).drop("_o")


def draw_within(rows: DataFrame, cluster: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each cluster (all, if fewer)."""
    order = Window.partitionBy(cluster).orderBy(_order(seed, cluster, item), item)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def draw_strata(clusters: DataFrame, key: str, n: int, extra: int, split: str = "split", seed: int = 0) -> DataFrame:
    """clusters with a stratum: n random ones, and extra ones of the test split that these don't hold.

    The strata are disjoint and are scored apart.
    """
    main = draw_clusters(clusters, key, n, seed).withColumn("stratum", F.lit("random"))
    rest = clusters.where(F.col(split) == "test").join(main.select(key), key, "left_anti")
    return main.unionByName(draw_clusters(rest, key, extra, seed + 1).withColumn("stratum", F.lit("test")))
