"""Structured Streaming jobs. Each micro-batch reuses the batch jobs; checkpoints live
under the shared ``spark.checkpoint.dir`` and offsets are committed only after a batch
has been written (at-least-once, made idempotent by per-batch overwrite)."""
