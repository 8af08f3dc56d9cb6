"""Derived-table steps the dataset notes describe: clean names, interpolation, lags, merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions.columns import clean_name
from kindling.operators import scan
from kindling.session import broadcast_if_small


def standardise_names(df: DataFrame) -> DataFrame:
    """Rename every column to its standardised form (D1); colliding names are an error."""
    new = [clean_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"standardised names collide: {new}")
    return df.toDF(*new)


def pivot_values(df: DataFrame, col: str, max_values: int = 1000, drop_null: bool = False) -> list:
    """Distinct values of a categorical column in order, for the columns of a pivot.

    More than ``max_values`` distinct values are refused: each becomes a column. A null has no column name, so it is
    refused too unless ``drop_null`` leaves it out."""
    vals = [r[0] for r in df.select(col).distinct().limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{col} has more than {max_values} distinct values; not a pivot column")
    if None in vals and not drop_null:
        raise ValueError(f"{col} has nulls; fill them or pass drop_null=True")
    return sorted(v for v in vals if v is not None)


def daily_grid(df: DataFrame, place: str, day: str, values) -> DataFrame:
    """``(place, day, values…)`` with every day between each place's first and last day;
    days without a row get nulls. Built from per-place ``sequence``, not a cross join."""
    values = [values] if isinstance(values, str) else list(values)
    span = df.groupBy(place).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(place, F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.join(df.select(place, day, *values), [place, day], "left")


def interpolate_linear(df: DataFrame, place: str, order: str, value: str, out: str | None = None,
                       long_places: bool = False) -> DataFrame:
    """Linear interpolation of missing values (null or NaN) in ``order`` within each place.

    A missing value between two known ones gets ``v0 + (v1 - v0)·(t - t0)/(t1 - t0)``; after the last known value it
    takes that (forward fill); before the first known value it is null. ``long_places``: a place may hold more rows
    than a task should sort; the table is cut into ranges of (place, order), written once, and known values are carried
    across ranges (``scan``). The result is the same."""
    out = out or value
    v = F.col(value)
    there = v.isNotNull() & ~F.isnan(v.cast("double"))
    known = F.when(there, F.struct(F.col(order).alias("t"), v.alias("v")))
    if long_places:
        d = scan.ranges(df, [place], [order])
        d = scan.carry(d, [place], [order], {"_p": known})
        d = scan.carry(d, [place], [order], {"_n": known}, forward=False).drop(scan.RANGE)
    else:
        before = Window.partitionBy(place).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # the next known value is the last one of the reversed order: running frames, linear in the rows of a place
        after = Window.partitionBy(place).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = df.withColumn("_p", F.last(known, ignorenulls=True).over(before)).withColumn(
            "_n", F.last(known, ignorenulls=True).over(after))
    t = F.col(order).cast("double")
    t0, v0 = F.col("_p.t").cast("double"), F.col("_p.v")
    t1, v1 = F.col("_n.t").cast("double"), F.col("_n.v")
    filled = (F.when(there, v)
              .when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), v0 + ((v1 - v0) * (t - t0)) / (t1 - t0))
              .when(F.col("_p").isNotNull(), v0))
    return d.withColumn(out, filled).drop("_p", "_n")


def lag_features(df: DataFrame, place: str, order: str, cols: Sequence[str], lags: Sequence[int],
                 long_places: bool = False) -> DataFrame:
    """``<col>_lag_<d>`` = the value ``d`` rows earlier within the place (D3). ``long_places`` as in
    :func:`interpolate_linear`: at most ``max(lags)`` rows per place and range travel between ranges."""
    if long_places:
        return scan.shift(scan.ranges(df, [place], [order]), [place], [order], list(cols), list(lags)).drop(scan.RANGE)
    w = Window.partitionBy(place).orderBy(order)
    out = df
    for c in cols:
        for d in lags:
            out = out.withColumn(f"{c}_lag_{d}", F.lag(c, d).over(w))
    return out


def merge_asof(base: DataFrame, *others: tuple[str, DataFrame, Sequence[str]], place: str, time: str,
               max_age: str | None = None) -> DataFrame:
    """Merge of sources with rhythms of their own (D4): each row of ``base`` with the latest row of every source at its
    place and at or before its time.

    Each of ``others`` is ``(name, table, columns)`` with the columns ``place`` and ``time`` in the table; the result has the columns of
    ``base`` and, per source, ``<name>_<column>`` and ``<name>_<time>`` (null where there is none, or none younger than
    ``max_age``, an interval such as ``"3 days"``: an older row is not used, a row of exactly that age is). Of several
    rows of a source at one place and time the greatest in its columns counts. Rows of ``base`` are kept as they are, repeated ones
    and those without place or time too; those get no source. A source row without place or time is left out.

    All tables are united and cut into ranges of (place, time); the latest row is carried along them (``scan``). There is
    no range join, one exchange serves all sources, and a place of any length spans many tasks."""
    names = [name for name, _, _ in others]
    taken = {f"{n}_{c}" for n, _, cols in others for c in (*cols, time)}
    if len(set(names)) != len(names) or taken & set(base.columns):
        raise ValueError("source names repeat or give columns that are there already")
    dtype = {n: t.select(F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]).alias("s")).schema["s"].dataType
             for n, t, cols in others}
    rows = base.select(F.col(place).alias("__place"), F.col(time).alias("__time"), F.lit(1).alias("__kind"),
                       F.struct(*base.columns).alias("__base"), *[F.lit(None).cast(dtype[n]).alias(f"__s_{n}") for n in names])
    for n, t, cols in others:
        own = F.max(F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)]))
        one = t.where(F.col(place).isNotNull() & F.col(time).isNotNull()).groupBy(
            F.col(place).alias("__place"), F.col(time).alias("__time")).agg(own.alias("s"))
        rows = rows.unionByName(one.select("__place", "__time", F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema["__base"].dataType).alias("__base"),
                                           *[(F.col("s") if m == n else F.lit(None).cast(dtype[m])).alias(f"__s_{m}") for m in names]))
    tagged = scan.ranges(rows, ["__place"], ["__time", "__kind"])
    found = scan.carry(tagged, ["__place"], ["__time", "__kind"], {f"__l_{n}": F.col(f"__s_{n}") for n in names})
    found = found.where("__kind = 1")
    usable = F.col("__place").isNotNull() & F.col("__time").isNotNull()
    out = ["__base.*"]
    for n, _, cols in others:
        latest = F.col(f"__l_{n}")
        fresh = usable if max_age is None else usable & (latest["t"] + F.expr(f"INTERVAL {max_age}") >= F.col("__time"))
        out += [F.when(fresh, latest["t"]).alias(f"{n}_{time}"), *[F.when(fresh, latest[f"c{i}"]).alias(f"{n}_{c}") for i, c in enumerate(cols)]]
    return found.select(*out)


def merge_sources(base: DataFrame, *others: tuple[DataFrame, list, bool], broadcast_rows: int = 100_000) -> DataFrame:
    """Chained left joins (D4). Each ``other`` is ``(table, keys, small)``; a side marked ``small`` is counted and
    broadcast if it has at most ``broadcast_rows`` rows; every other side is left to the planner and AQE."""
    out = base
    for tbl, keys, small in others:
        out = out.join(broadcast_if_small(tbl, broadcast_rows) if small else tbl, keys, "left")
    return out
