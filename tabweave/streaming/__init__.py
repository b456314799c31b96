"""Re-running the transformation as examples arrive.

The engine's loop is a batch; a stream of examples drives it through foreachBatch. Examples are kept in a folder, so that
a restarted stream goes on with all of them; a batch that is delivered again overwrites its own file and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def on_examples(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """stream (k, v, score). After each batch, transform(all examples so far) goes to sink(result, batch id)."""

    def batch(df: DataFrame, i: int) -> None:
        df.select("k", "v", "score").write.mode("overwrite").parquet(f"{folder}/batch={i}")
        every = df.sparkSession.read.parquet(folder).where(f"batch <= {i}").groupBy("k", "v").agg({"score": "max"}).toDF("k", "v", "score")
        sink(transform(every), i)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
