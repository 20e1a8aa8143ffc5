"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CLASSES = 4096


def per_class(rows: DataFrame, label: str, key: str, most: int, total: int | None = None) -> DataFrame:
    """About ``most`` rows of each class, all of smaller ones, chosen by a hash of
    ``key``; the same rows on every run.  With ``total``, classes share that number
    evenly where ``most`` of each would be more.

    Rows with equal keys are chosen together; those without a key are never chosen
    unless all of their class are.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    n = counts.count()
    if n > MOST_CLASSES:
        raise ValueError(f"{n} different values of {label}: at most {MOST_CLASSES} can be told apart")
    if total and n:
        most = max(1, min(most, total // n))
    scale = 1 << 30
    chosen = (F.col("_n") <= most) | (F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(scale)) < (F.lit(float(scale * most)) / F.col("_n")).cast("long"))
    counts = F.broadcast(counts)  # MOST_CLASSES rows at most
    return rows.join(counts, F.col(label) == F.col("_class")).where(chosen).select(*rows.columns)
