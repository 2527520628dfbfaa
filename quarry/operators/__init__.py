"""Batch jobs: DataFrames in, DataFrames out, no actions."""
