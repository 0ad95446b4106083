"""Order-independent merge rules: every fold built from them gives one result for any arrival order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = {"started": 0, "stopped": 1, "output_observed": 1, "completed": 2, "ended": 2}


def min_non_null(column: str) -> Column:
    """The smallest non-null value wins."""
    return F.min(column)


def newest_wins(columns: list[str], order: list[str]) -> Column:
    """All columns of the row with the greatest order key, nulls included, as one struct."""
    return F.max_by(F.struct(*columns), F.struct(*order))


def status_rank(status: Column) -> Column:
    """Place of a status in the lattice; null for other labels."""
    return F.coalesce(*[F.when(status == k, r) for k, r in RANKS.items()])


def advance_status(status: Column, order: list[str]) -> Column:
    """The label that reached the highest rank, by the earliest event that did: an equal rank never replaces."""
    return F.min_by(status, F.struct(-status_rank(status), *order))


def fill_once(column: str) -> Column:
    """The one non-null value that all writers agree on; the smallest where they do not, which ``disagree`` tells."""
    return F.min(column)


def disagree(column: str) -> Column:
    """Whether the non-null values of a fill-once property differ."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def provenance(column: str) -> Column:
    """Sorted distinct sources."""
    return F.array_sort(F.collect_set(column))
