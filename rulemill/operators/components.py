"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.session import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Self-loops and repeated edges are allowed.

    Each round every node takes the smallest grandparent among its neighbours
    and its parent hooks onto it too, so that paths halve: rounds grow with the
    logarithm of the longest path. All steps are minimum aggregates, which
    combine before the shuffle; no neighbourhood is ever gathered. The state is
    cut after every round.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = cut(pairs.union(pairs.select("v", "u")).distinct())
    state = old = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("f")))
    while True:
        parents = state.select(F.col("u").alias("p"), F.col("f").alias("g"))
        grand = state.join(parents, state.f == parents.p).select("u", "f", "g")
        near = pairs.join(grand.select(F.col("u").alias("v"), F.col("g").alias("gv")), "v").groupBy("u").agg(F.min("gv").alias("m"))
        step = grand.join(near, "u").select("u", "f", F.least("g", "m").alias("n"))
        offers = step.select("u", "n", "f").union(step.select(F.col("f").alias("u"), "n", F.lit(None).cast("long").alias("f")))
        new = cut(offers.groupBy("u").agg(F.min("n").alias("n"), F.max("f").alias("old")).select("u", F.least("n", "old").alias("f"), (F.col("n") < F.col("old")).alias("moved")))
        discard(old)
        state, old = new.select("u", "f"), new
        if not new.where("moved").head(1):
            discard(pairs)
            return state.select(F.col("u").alias("node"), F.col("f").alias("component"))
