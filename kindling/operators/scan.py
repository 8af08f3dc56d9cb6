"""Ordered scans within groups that are never one task: carried values, shifted rows and exact row numbers.

``Window.partitionBy(place).orderBy(t)`` sorts all rows of a place in one task. Here rows are cut into ranges of
(place, t) first, so a long place spans many ranges and a range may hold many short places. A small table (one row per
place and range) carries what a range needs from those before it; the rest is a window inside (place, range). The
results equal the plain windows for any data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions.columns import hash_order
from kindling.session import cut_lineage

RANGE = "__range"


def ranges(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n: int | None = None) -> DataFrame:
    """``df`` with the range (an int that grows with the order) of each row, written once so that the tags hold.

    Bounds come from a sample of (group, order), so ranges are even; ties of both fall into one range. Without ``n``
    there are as many ranges as shuffle partitions."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*group_cols, *order_cols)]
    return cut_lineage(df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id()))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` where a null group equals a null group; the keys of ``right`` are dropped."""
    renamed = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, "left").drop(*[f"__r{i}" for i in range(len(keys))])


def carry(tagged: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], values: dict[str, Column],
          forward: bool = True) -> DataFrame:
    """``tagged`` (from :func:`ranges`) with a column per entry of ``values``: the last non-null value of that
    expression up to and with this row in the order of the group, or with ``forward=False`` the next one from this row
    on. Rows that tie in the order stand in no defined order; give a full key where that matters.
    """
    g = list(group_cols)
    up = [F.col(c).asc_nulls_first() for c in order_cols]
    down = [F.col(c).desc_nulls_last() for c in order_cols]
    names = list(values)
    d = tagged.withColumns({f"__v_{k}": v for k, v in values.items()})
    # what a range passes on: its value at the far end of the order
    pick = F.max_by if forward else F.min_by
    place = F.struct(*order_cols)
    known = lambda k: F.when(F.col(f"__v_{k}").isNotNull(), place)
    ends = d.groupBy(*g, RANGE).agg(*[pick(F.col(f"__v_{k}"), known(k)).alias(f"__e_{k}") for k in names])
    before = Window.partitionBy(*g).orderBy(F.col(RANGE).asc() if forward else F.col(RANGE).desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    given = ends.select(*g, RANGE, *[F.last(f"__e_{k}", ignorenulls=True).over(before).alias(f"__c_{k}") for k in names])
    joined = _join_null_safe(d, given, [*g, RANGE])
    within = Window.partitionBy(*g, RANGE).orderBy(*(up if forward else down)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({k: F.coalesce(F.last(f"__v_{k}", ignorenulls=True).over(within), F.col(f"__c_{k}")) for k in names})
    return out.drop(*[f"__v_{k}" for k in names], *[f"__c_{k}" for k in names])


def shift(tagged: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], columns: Sequence[str],
          steps: Sequence[int], name: str = "{column}_lag_{step}") -> DataFrame:
    """``tagged`` with ``columns`` as they were ``steps`` rows earlier in the group.

    Inside a range that is ``lag``. A row among the first ``max(steps)`` of its range takes the rest from the last rows
    of the ranges before it: at most ``max(steps)`` rows per group and range travel, as one array per group and range.
    """
    g, most = list(group_cols), max(steps)
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    within = Window.partitionBy(*g, RANGE).orderBy(*order)
    d = tagged.withColumn("__k", F.row_number().over(within))
    back = Window.partitionBy(*g, RANGE).orderBy(*[F.col(c).desc_nulls_last() for c in order_cols])
    tails = (tagged.withColumn("__t", F.row_number().over(back)).where(F.col("__t") <= most)
             .groupBy(*g, RANGE).agg(F.array_sort(F.collect_list(F.struct("__t", F.struct(*columns).alias("v")))).alias("__tail")))
    # the last rows before a range, the nearest first: those of the range before it, then of the one before that, ...
    before = Window.partitionBy(*g).orderBy(RANGE).rowsBetween(-most, -1)
    given = tails.select(*g, RANGE, F.slice(F.flatten(F.reverse(F.collect_list("__tail").over(before))), 1, most).alias("__given"))
    joined = _join_null_safe(d, given, [*g, RANGE])
    new = {}
    for c in columns:
        for s in steps:
            earlier = F.get(F.col("__given"), F.lit(s) - F.col("__k")).getField("v").getField(c)
            new[name.format(column=c, step=s)] = F.when(F.col("__k") > s, F.lag(c, s).over(within)).otherwise(earlier)
    return joined.withColumns(new).drop("__k", "__given")


def row_index(df: DataFrame, key: str, salt: str, n: int | None = None, out: str = "index") -> DataFrame:
    """``df`` with each row's exact place (from 0) in the order of the md5 of ``salt`` and ``key``, then ``key``.

    An md5 is uniform, so equal ranges of its first digits are even and no sample is needed; their sizes give the
    offsets. Rows of one key stand in no defined order among themselves."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__h", hash_order(key, salt))
    d = d.withColumn(RANGE, F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int"))
    sizes = d.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(RANGE, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    within = Window.partitionBy(RANGE).orderBy("__h", key)
    out_df = d.join(F.broadcast(offsets), RANGE)  # n rows
    return out_df.withColumn(out, F.col("__o") + F.row_number().over(within) - 1).drop("__h", RANGE, "__o")
