"""The foreachBatch handler surface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def with_trigger(writer: DataStreamWriter, trigger: dict | None) -> DataStreamWriter:
    """``{"availableNow": True}`` (tests, catch-up) or ``{"processingTime": "300 seconds"}``."""
    t = trigger or {"availableNow": True}
    return writer.trigger(**t)


def run_handler(stream: DataFrame, handle: Callable[[DataFrame, int], None],
                on_error: Callable[[DataFrame, int, Exception], None] | None, checkpoint: str,
                trigger: dict | None = None, name: str | None = None,
                output_mode: str = "append") -> StreamingQuery:
    """The user handler gets each micro-batch as a DataFrame. A failing handler hands
    the batch to ``on_error`` (e.g. a dead-letter write) in the same micro-batch, so the
    offset commit never skips unrecorded data; without ``on_error`` the query fails and
    the batch is retried from the checkpoint."""
    def _run(df: DataFrame, batch_id: int) -> None:
        try:
            handle(df, batch_id)
        except Exception as exc:  # handed to the error hook, not swallowed
            if on_error is None:
                raise
            on_error(df, batch_id, exc)

    w = stream.writeStream.foreachBatch(_run).option("checkpointLocation", checkpoint).outputMode(output_mode)
    if name:
        w = w.queryName(name)
    return with_trigger(w, trigger).start()


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Idempotent per-batch output: a retried batch overwrites its own folder."""
    df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")
