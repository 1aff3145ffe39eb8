"""Incremental indexing of documents that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import postings


def index_arrivals(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of new documents(doc_id, text, ...) and stops when all present files are done.

    Postings of a document are made from that document alone, so a batch needs
    no state; a batch that runs again writes the same folder again.
    """

    def batch(df: DataFrame, n: int) -> None:
        postings(df.select(F.col("doc_id").alias("id"), "text")).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
