"""The same chain over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.plans.audit import file_stats, optimize_documents, run_totals


def stream_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Statistics of each arriving document: stateless, append mode."""
    return file_stats(optimize_documents(docs, key, text), key)


def stream_totals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Running totals, for complete mode."""
    return run_totals(stream_stats(docs, key, text))


def write_stats(docs: DataFrame, key: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the statistics of every batch as Parquet, each once, until what there is has been read."""
    return stream_stats(docs, key, text).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_outputs(docs: DataFrame, key: str, text: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the changed documents of every batch as Parquet, each once."""
    out = optimize_documents(docs, key, text).where("text_before <> text_after").select(key, "text_after")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
