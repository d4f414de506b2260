"""Change rows from a stream, each key once, however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame


def once(stream: DataFrame, keys: list[str], path: str, checkpoint: str):
    """A writer that appends rows of unknown keys to the table at ``path``.

    Keys met are state of the stream, in its checkpoint, so a batch reads its own rows alone; the file sink's log makes a
    batch that is repeated after a failure count once. The first row of a key counts, and of one batch any one of them.
    """
    rows = stream.dropDuplicates(keys)
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
