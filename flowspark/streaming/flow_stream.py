"""The row-wise part of triage on a stream of flow records.

Describing and labelling need no state, so the batch functions apply unchanged; results are
appended batch by batch; the checkpoint keeps a batch from being written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from flowspark.functions.describe import describe


def describe_stream(flows: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Describe every record of a streaming table and append it to a table."""
    writer = describe(flows).writeStream.format("parquet").outputMode("append").option("path", target)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
