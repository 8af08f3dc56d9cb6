"""Feature catalog: keyword groups, lag groups, group profiles and a real feature ranking.

The catalog is computed over feature *names* (one row per column, a schema-sized
table) and attached to the long form ``(…, feature, value)`` of the data, so the
profile of every group is one distributed aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.session import broadcast_if_small

from kindling.functions.columns import sql_ident, stack_expr
from kindling.operators.moments import moments

# The keyword for each feature group, matched as a substring of the
# lower-cased column name; names in no group go to "other".
DEFAULT_GROUPS = (
    ("vegetation", "ndvi"),
    ("moisture", "moisture"),
    ("temperature", "temp"),
    ("precipitation", "precip"),
    ("wind", "wind"),
)
OTHER = "other"
# The columns the reference treats as label and date.
DEFAULT_EXCLUDE = ("is_fire", "acq_date")
# Fixed value: what counts as an integer token in a lag name.
INT_TOKEN = r"^\s*[+-]?[0-9]+\s*$"


def names_frame(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """One row per column name; the size is the width of a schema."""
    names = list(dict.fromkeys(names))
    return spark.createDataFrame([(n,) for n in names], "feature string")


def feature_group_catalog(names: DataFrame, groups: Sequence[tuple[str, str]] = DEFAULT_GROUPS,
                          exclude: Sequence[str] = ("is_fire",)) -> DataFrame:
    """``(feature, group)``: a name is in every group whose keyword it contains
    (case-insensitive substring, so groups overlap); names in none are ``other`` (F1)."""
    names = names.filter(~F.col("feature").isin(*exclude)) if exclude else names
    kw = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(k.lower()).alias("keyword")) for g, k in groups])
    hits = F.array_distinct(F.transform(F.filter(kw, lambda g: F.lower(F.col("feature")).contains(g["keyword"])),
                                        lambda g: g["group"]))
    tags = F.when(F.size(hits) == 0, F.array(F.lit(OTHER))).otherwise(hits)
    return names.select("feature", F.explode(tags).alias("group"))


def lag_catalog(names: DataFrame, exclude: Sequence[str] = DEFAULT_EXCLUDE, keep_lag_zero: bool = False) -> DataFrame:
    """``(feature, lag)`` (F2).

    A name containing "lag" (any case) is split on '_'; scanning left to right, the
    first token equal to "lag" whose next token parses as an integer gives the lag.
    Names with "lag" that never parse are in no group. Names without "lag" form lag
    0, except ``exclude``. Names that parse to lag 0 are dropped unless
    ``keep_lag_zero`` (the reference overwrites that group).
    """
    tokens = F.split(F.col("feature"), "_")
    idx = F.when(F.size(tokens) >= 2, F.sequence(F.lit(0), F.size(tokens) - 2)).otherwise(
        F.array().cast("array<int>"))
    def as_int(tok):
        # Python int(): optional sign and digits, surrounding whitespace allowed.
        return F.when(tok.rlike(INT_TOKEN), F.trim(tok).try_cast("bigint"))

    cands = F.filter(
        F.transform(idx, lambda i: F.when(F.lower(F.get(tokens, i)) == "lag", as_int(F.get(tokens, i + 1)))),
        lambda v: v.isNotNull())
    parsed = F.get(cands, 0)
    has_lag = F.lower(F.col("feature")).contains("lag")
    lagged = names.filter(has_lag).select("feature", parsed.alias("lag")).filter(F.col("lag").isNotNull())
    if not keep_lag_zero:
        lagged = lagged.filter(F.col("lag") != 0)
    plain = names.filter(~has_lag)
    if exclude:
        plain = plain.filter(~F.col("feature").isin(*exclude))
    return lagged.unionByName(plain.select("feature", F.lit(0).cast("bigint").alias("lag")))


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Wide → long ``(ids…, feature, value double)`` with one ``stack`` generator (a single
    expression however many columns, cheaper to plan and run than ``unpivot`` on wide tables)."""
    return df.selectExpr(*[sql_ident(i) for i in ids], stack_expr(list(features)))


def tag(long: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach catalog tags to the long table; the catalog (a row per feature and tag) is broadcast once counted."""
    return long.join(broadcast_if_small(catalog), "feature")


def feature_profile(long: DataFrame) -> DataFrame:
    """Per feature: ``(feature, n_values, n_null, n, mean, m2, min, max)``; null and NaN count as null, ``m2`` is the
    sum of squared deviations of the ``n`` others."""
    ok = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_values"), (F.count(F.lit(1)) - F.count(ok)).alias("n_null"), F.count(ok).alias("n"),
        F.avg(ok).alias("mean"), (F.var_pop(ok) * F.count(ok)).alias("m2"), F.min(ok).alias("min"), F.max(ok).alias("max"))


def group_profile(long: DataFrame, catalog: DataFrame, group_col: str = "group") -> DataFrame:
    """Per group of the catalog: values, nulls, mean, population std, min, max.

    The long table is aggregated per feature first, map-side; the catalog is joined to that feature-sized result, and
    the groups merge their features' counts, means and squared deviations."""
    return _group_profile(feature_profile(long), catalog, group_col)


def group_profile_wide(df: DataFrame, features: Sequence[str], catalog: DataFrame, group_col: str = "group") -> DataFrame:
    """:func:`group_profile` of a wide table without its long form: the features' moments come from one pass over the
    columns, a row per task."""
    m = moments(df, list(dict.fromkeys(features)))
    profile = m.select("feature", F.col("rows").alias("n_values"), (F.col("rows") - F.col("n")).alias("n_null"), "n", "mean",
                       F.when(F.col("n") > 0, F.col("m2")).alias("m2"), "min", "max")
    return _group_profile(profile, catalog, group_col)


def _group_profile(profile: DataFrame, catalog: DataFrame, group_col: str) -> DataFrame:
    f = profile.join(catalog, "feature")
    total, n = F.sum("n"), F.col("n")
    sums = f.groupBy(group_col).agg(
        F.sum("n_values").cast("bigint").alias("n_values"), F.sum("n_null").cast("bigint").alias("n_null"),
        total.alias("n"), F.sum(n * F.col("mean")).alias("s"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.sum("m2").alias("within"), F.collect_list(F.struct("n", "mean")).alias("parts"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    sums = sums.withColumn("mean", mean)
    between = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.when(
        x.n > 0, x.n * (x.mean - F.col("mean")) * (x.mean - F.col("mean"))).otherwise(0.0))
    std = F.when(F.col("n") > 0, F.sqrt((F.col("within") + between) / F.col("n")))
    return sums.select(group_col, "n_values", "n_null", "mean", std.alias("std"), "min", "max")


def feature_rank(df: DataFrame, features: Sequence[str], label: str, top: int = 30) -> DataFrame:
    """Features ranked by ``|corr(x, label)|``, highest first, top ``top`` (F5, K1). A row counts for a feature if value
    and label are neither null nor NaN; a feature without a correlation (constant, or no such rows) comes last. One pass
    over the table, a row of vectors per task. For the importance of a fitted model see ``importance``."""
    spread = F.sqrt(F.col("m2_x")) * F.sqrt(F.col("m2_y"))
    scores = moments(df, list(dict.fromkeys(features)), label).select(
        "feature", F.when((F.col("m2_x") > 0) & (F.col("m2_y") > 0), F.col("c_xy") / spread).alias("corr"))
    from kindling.operators.evaluate import top_n

    return top_n(scores.withColumn("importance", F.abs("corr")), "importance", top, tie="feature")
