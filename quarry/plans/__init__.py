"""Registered, runnable jobs over the driver tables (what ``__spark_entry__`` exposes)."""
