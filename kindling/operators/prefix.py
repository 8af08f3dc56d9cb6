"""Running sums in value order without a one-task window.

``Window.orderBy(x)`` with no partition key moves every row into one task. Here the
rows are first cut into value ranges (buckets): bucket totals form a small table
(groups × buckets rows) whose own running sum gives each bucket's offset, and the
exact running sum inside a bucket is a window partitioned by (group, bucket).
The result equals the one-task window exactly, for any data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_buckets(df: DataFrame, group_cols: Sequence[str], order_col: str, n: int | None = None,
                  out: str = "_bk") -> DataFrame:
    """Tag rows with their range-partition index over ``(group, order)``.

    Range bounds come from a sample, so buckets hold similar row counts whatever
    the value distribution. The index is only stable within one plan: checkpoint
    the result before using the tag in more than one branch.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *group_cols, order_col).withColumn(out, F.spark_partition_id())


def running_sums_desc(df: DataFrame, group_cols: Sequence[str], order_col: str, sum_cols: Sequence[str],
                      lo: float = 0.0, hi: float = 1.0, n_buckets: int = 1 << 16,
                      prefix: str = "cum_", bucket_col: str | None = None,
                      next_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>`` = Σ c over rows of the same group whose ``order_col`` is >= this row's,
    and the group total ``tot_<c>``.

    ``df`` must hold one row per (group, order value), e.g. distinct scores with
    their counts. Buckets are either ``bucket_col`` (any integer tag that does not
    decrease with the order value within a group, e.g. from :func:`range_buckets`)
    or equal-width ranges of ``[lo, hi]`` (values outside fall into the edge
    buckets). Buckets only spread the work; they never change the result.

    ``next_cols`` adds ``next_<c>``: the value of ``c`` on the next lower row of the
    group (null on the last row) — ``lead`` inside the bucket, and at a bucket's
    lowest row the top row of the next non-empty lower bucket, carried by the small
    bucket table. No self-join over all rows.
    """
    g = list(group_cols)
    if bucket_col:
        d = df.withColumnRenamed(bucket_col, "_bk") if bucket_col != "_bk" else df
    else:
        x = F.col(order_col).cast("double")
        span = float(hi) - float(lo)
        b = F.floor((x - F.lit(float(lo))) / F.lit(span) * F.lit(n_buckets))
        b = F.least(F.greatest(b, F.lit(0)), F.lit(n_buckets - 1)).cast("int")
        d = df.withColumn("_bk", b)
    head = [F.max_by(F.struct(*next_cols), order_col).alias("_head")] if next_cols else []
    totals = d.groupBy(*g, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols], *head)
    before = Window.partitionBy(*g).orderBy(F.col("_bk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    next_head = ([F.lead("_head").over(Window.partitionBy(*g).orderBy(F.col("_bk").desc())).alias("_next_head")]
                 if next_cols else [])
    offsets = totals.select(*g, "_bk",
                            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
                            *[F.sum(f"_t_{c}").over(whole).alias(f"tot_{c}") for c in sum_cols], *next_head)
    # offsets has at most groups × n_buckets rows; AQE turns this join into a
    # broadcast when the materialised side is small and keeps a shuffle join otherwise.
    joined = d.join(offsets, [*g, "_bk"])
    within = Window.partitionBy(*g, "_bk").orderBy(F.col(order_col).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for c in sum_cols:
        joined = joined.withColumn(prefix + c, F.col(f"_o_{c}") + F.sum(c).over(within))
    order_only = Window.partitionBy(*g, "_bk").orderBy(F.col(order_col).desc())
    for c in next_cols:
        joined = joined.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(order_only), F.col(f"_next_head.{c}")))
    return joined.drop("_bk", "_next_head", *[f"_o_{c}" for c in sum_cols])
