"""References to records that are not there, by period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_end(moment: Column) -> Column:
    """The first instant of the month after."""
    return F.add_months(F.trunc(moment, "month"), 1).cast("timestamp")


def presence(rows: DataFrame, keys: list[str], came: str, left: str) -> DataFrame:
    """For each key the spans of month ends at which a row with it is there.

    A row is there at a month end if it came before it and left not before it.
    Spans are distinct, so a key with very many rows shrinks to at most one row
    for each pair of months before it is shuffled.
    """
    came_at, left_at = F.col(came), F.col(left)
    # The last month end not after the moment of leaving; a row that leaves at the very instant is still there.
    last = F.when(left_at.isNotNull(), F.trunc(left_at, "month").cast("timestamp"))
    return rows.where(came_at.isNotNull()).select(*keys, month_end(came_at).alias("_from"), last.alias("_to")).distinct()


def orphans(references: DataFrame, targets: DataFrame, columns: list[str], came: str, left: str, match: str = "partial") -> DataFrame:
    """The rows of ``references`` (columns, period_end, ...) that no target row could mean at period_end.

    Composite keys may be null in part. ``match`` declares what that means:
    'partial' - the columns that are not null must match (a key that is null
    in all columns is no reference); 'simple' - a key with any null column is
    no reference; 'full' - such a key is always an orphan. References are
    grouped by their null mask and each mask is anti-joined on its own columns,
    so that every join is an equi-join. Distinct (key, period) are joined,
    and targets are reduced to presence spans before: neither side brings a hot
    key into one task. Null target keys match nothing.
    """
    wanted = references.select(*columns, "period_end").distinct()
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    wanted = wanted.where(~all_null)
    missing = []
    if len(columns) > 1 and match == "full":
        missing.append(wanted.where(any_null))
    for mask in range(1, 2 ** len(columns)):
        used = [c for i, c in enumerate(columns) if mask >> i & 1]
        if len(used) < len(columns) and match != "partial":
            continue
        part = wanted.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in used else F.col(c).isNull() for c in columns]))
        there = presence(targets, used, came, left).select(*[F.col(c).alias(f"_{c}") for c in used], "_from", "_to")
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in used])
        in_time = (F.col("_from") <= F.col("period_end")) & (F.col("_to").isNull() | (F.col("period_end") <= F.col("_to")))
        missing.append(part.join(there, on & in_time, "left_anti"))
    gone = reduce(DataFrame.unionByName, missing)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*columns, "period_end"]])
    return references.alias("r").join(gone.alias("g"), same, "left_semi")
