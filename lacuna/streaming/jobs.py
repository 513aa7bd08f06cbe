"""The same transforms on a stream: detection and redaction hold no state, so each micro-batch is a job of its own.

Defined cases: those of detection and redaction, batch by batch: a null text counts as empty, repeated rows and ids stay
apart, other columns stay; an empty stream gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lacuna.operators.detect import detect
from lacuna.operators.redact import redact


def redact_stream(documents: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """A stream of documents with ``matches, redacted_text, mapping``."""
    return redact(detect(documents, text_col, **options), text_col)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once by the checkpoint; all that is there is read, then it ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
