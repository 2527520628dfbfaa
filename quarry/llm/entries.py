"""Vector rows whose entries are finite, as whole numbers on a grid of 1/64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vec: Column) -> Column:
    """True for a non-null array<double> without null or non-finite entries."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vec.isNotNull() & F.forall(vec, fine)


def on_grid(vec: Column, limit: float, shift: int = 0) -> Column:
    """floor(64 * x) + shift of every entry, as array<long>. An entry beyond ``limit`` has no place
    in the results' whole numbers and raises an error."""

    def place(x):
        checked = F.when(F.abs(x) <= limit, F.floor(x * 64.0) + F.lit(shift).cast("long"))
        return F.coalesce(checked, F.raise_error(F.lit(f"vector entry beyond {limit:g}")).cast("long"))

    return F.transform(vec, place)
