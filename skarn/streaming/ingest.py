"""Continuous ingest: new raw filings go to the table once, whatever is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skarn.schemas import FILING_DDL
from skarn.sources.sinks import append_new


def filings_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON files, one filing each, that come into a folder."""
    return spark.readStream.schema(FILING_DDL).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends filings with a new accession_no to table; each batch is idempotent, so a replay adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        append_new(rows.where("accession_no is not null"), table, "accession_no")

    writer = filings_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
