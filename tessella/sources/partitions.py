"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes (as Spark estimates them) for each core below which rows are dealt out anew before costly work.
SMALL = 8 << 20


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` on all cores, where they are so small that a file or two would keep few of them busy.

    Only then rows are shuffled; a large input comes in many parts by itself and stays where it is, and so
    does a stream.
    """
    if docs.isStreaming:
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SMALL else docs
