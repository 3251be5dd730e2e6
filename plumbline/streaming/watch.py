"""The batch diff on each new manifest of a folder: an extension by structured streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.manifest import MANIFEST


def watch(spark: SparkSession, folder: str, checkpoint: str, on_manifest: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call ``on_manifest`` with the manifests that arrived since the last batch; progress is kept in ``checkpoint``."""
    stream = spark.readStream.schema(MANIFEST).option("multiLine", True).json(folder)
    return stream.writeStream.foreachBatch(on_manifest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
