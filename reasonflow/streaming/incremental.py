"""Analysing record files as they arrive, each file once.

Structured Streaming keeps track of the files already read in a checkpoint, so a run
that stops goes on where it was.  Nothing here has state: each record stands for itself.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import shape
from ..plans.analyses import segmented


def segment_arriving(spark: SparkSession, source: str, target: str, checkpoint: str, files_a_trigger: int = 100) -> StreamingQuery:
    """Segments the attempts of JSON-lines files appearing in ``source`` and appends them to ``target``; ends when there are no more."""
    stream = spark.readStream.schema(schemas.RECORDS).option("maxFilesPerTrigger", files_a_trigger).json(source)
    rows = segmented(shape.attempts(stream))
    return rows.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
