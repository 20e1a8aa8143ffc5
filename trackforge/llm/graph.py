"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pin, unpin


def roots(parents: DataFrame) -> DataFrame:
    """``parents(a, b)`` of a forest (each ``a`` once, ``b`` another node) to
    ``(node, label)`` for each ``a``: the root above it.  Each round jumps twice as
    far, so there are as many rounds as the depth has binary digits."""
    p = pin(parents.select("a", "b"), "roots")
    while True:
        up = p.select(F.col("a").alias("via"), F.col("b").alias("top"))
        jumped = p.join(up, p["b"] == up["via"], "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("moved"))
        jumped = pin(jumped, "roots")
        if jumped.where("moved").isEmpty():
            unpin(p)
            return jumped.select(F.col("a").alias("node"), F.col("b").alias("label"))
        unpin(p)
        p = jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014).  Each
    round only takes minima per node, which combine before the shuffle, so a
    hub of any degree is no single task's burden.  Ends when a round changes
    nothing.
    """
    spark = edges.sparkSession
    e = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    state = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        before, e = e, pin(small.where("u <> v").distinct(), "cc")
        unpin(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # every node now hangs on its smallest; the smallest ones label themselves
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
