"""Changes between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with the same keys the one that is last in ``order`` (nulls first).

    A max_by aggregate, so each map task sends at most one row a key.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def snapshot_steps(rows: DataFrame, snapshot: str) -> DataFrame:
    """(s, to): each snapshot number and the next one there is. The window is over distinct numbers, one a delivery."""
    numbers = rows.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("s")).distinct()
    return numbers.withColumn("to", F.lead("s").over(Window.orderBy("s"))).where("to IS NOT NULL")


def snapshot_changes(rows: DataFrame, snapshot: str, key: str, content: list[Column]) -> DataFrame:
    """Label what changed between each snapshot and the one before it.

    ``rows`` holds one row for each (snapshot, key). Each snapshot is compared
    with the one of the next smaller number there is; the first yields nothing.
    Content is compared null-safe, column by column, through a digest of all of
    it; a single column is taken as it is. Identical rows leave by EXCEPT ALL in both directions; what is left on
    either side is full-joined by key: on one side only it was added or
    removed, on both it changed.

    Returns (snapshot, key, change_kind). Rows whose snapshot or key is null
    belong to no snapshot or record and are left out. An empty table, or one
    with a single snapshot, gives no rows.
    """
    digest = content[0] if len(content) == 1 else F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(content)]), {"ignoreNullFields": "false"}), 256)
    state = rows.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(F.col(snapshot).alias("s"), F.col(key).alias("k"), digest.alias("d"))
    # One row a delivery: a daily one makes 36,500 rows in a century.
    steps = F.broadcast(snapshot_steps(state, "s"))
    before = state.join(steps, "s").select(F.col("to").alias("s"), "k", "d")
    after = state.join(F.broadcast(steps.select(F.col("to").alias("s"))), "s").select("s", "k", "d")
    gained = after.exceptAll(before).select("s", "k", F.lit(True).alias("new"))
    lost = before.exceptAll(after).select("s", "k", F.lit(True).alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return gained.join(lost, ["s", "k"], "full").select(F.col("s").alias(snapshot), F.col("k").alias(key), kind.alias("change_kind"))
