"""Preparation: time split, class counts, exact repeatable balancing, shuffle order, scaling.

Scale notes
-----------
* ``time_split`` tags both parts in one scan; ``split_part`` is a plain filter that
  Catalyst pushes into the parquet scan when only one part is wanted.
* ``balanced_sample`` never ranks a whole class in one task. Rows get a repeatable
  md5 order key; a histogram over the first hex digits of that key (a bounded
  table: parts × 2 labels × 16**digits rows) shows, per (part, label), the bucket
  where the running count reaches k. Only rows of that crossing bucket are ranked,
  to find the k-th smallest (key hash, key) of the class, with repeated keys counted
  first; the sample is then one narrow filter against that cutoff. The result is exactly the k smallest keys,
  the same rows a global ``row_number`` would keep. Three scans of the source
  (histogram, crossing bucket, selection), no union, no full-class window.
* Scaler statistics are mergeable moments: one row of vectors per task, whatever
  the number of columns. Only the parameter rows (one per feature) reach the
  driver, to become literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindling.functions.columns import hash_order, sql_clean_double, sql_double, sql_ident
from kindling.operators.moments import moments
from kindling.session import cut_lineage

TRAIN, VALID = "train", "valid"


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns that exist; absent ones are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def instant(value, dtype) -> F.Column:
    """A cut point as a literal of the column's own type.

    Written as text and cast, so a wall-clock cut against a ``timestamp_ntz`` column
    never passes through the session or Python time zone."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") and hasattr(value, "hour") else str(value)
    return F.lit(text).cast(dtype)


def time_split(df: DataFrame, ts: str, cut, part_col: str = "part") -> DataFrame:
    """Tag rows ``train`` (ts < cut) or ``valid`` (ts >= cut); rows without ts are dropped."""
    cut_col = instant(cut, df.schema[ts].dataType)
    part = F.when(F.col(ts) < cut_col, F.lit(TRAIN)).when(F.col(ts) >= cut_col, F.lit(VALID))
    return df.withColumn(part_col, part).filter(F.col(part_col).isNotNull())


def split_part(df: DataFrame, ts: str, cut, which: str) -> DataFrame:
    """One part only, as a filter on ``ts`` that reaches the parquet scan."""
    cut_col = instant(cut, df.schema[ts].dataType)
    cond = F.col(ts) < cut_col if which == TRAIN else F.col(ts) >= cut_col
    return df.filter(cond)


def table_profile(df: DataFrame, part_col: str | None = None, with_all: bool = False) -> DataFrame:
    """Rows and columns per part (or of the whole table) in one pass (S2); ``with_all`` adds the row of the whole
    table, all rows whatever their part, from the same scan."""
    n_cols = len(df.columns) - (1 if part_col else 0)
    if part_col is None:
        out = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part", F.lit("all"))
    elif with_all:
        out = df.rollup(part_col).agg(F.count(F.lit(1)).alias("n_rows"), F.grouping(part_col).alias("_all"))
        out = out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(part_col)).alias("part"), "n_rows")
    else:
        out = df.groupBy(F.col(part_col).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return out.select("part", "n_rows", F.lit(n_cols).alias("n_cols"))


def class_counts(df: DataFrame, label: str, part_col: str = "part") -> DataFrame:
    """Rows per (part, label)."""
    return df.groupBy(part_col, label).agg(F.count(F.lit(1)).alias("n"))


def rows_per_class(counts: DataFrame, label: str, part_col: str = "part", cap: int | None = None) -> DataFrame:
    """k per part: the smaller of the label-0 and label-1 counts, lowered to ``cap``.

    ``cap`` of None or 0 means no cap. A part lacking one of the two classes fails
    with a clear error when the plan runs.
    """
    per_part = counts.groupBy(part_col).agg(
        F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("n0"),
        F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("n1"),
    )
    k = F.least(F.col("n0"), F.col("n1"))
    if cap:
        k = F.least(k, F.lit(int(cap)).cast("bigint"))
    k = F.when(
        F.col("n0").isNull() | F.col("n1").isNull(),
        F.raise_error(F.concat(F.lit("balanced sample: a class is missing in part "), F.col(part_col).cast("string"))),
    ).otherwise(k)
    return per_part.select(part_col, "n0", "n1", k.cast("bigint").alias("k"))


def balanced_sample(df: DataFrame, key: str, label: str, part_col: str = "part", cap: int | None = None,
                    seed: int = 42, digits: int = 4) -> DataFrame:
    """Exactly k rows of label 0 and k of label 1 per part, chosen by the md5 order of ``seed:key``.

    The histogram and the cutoff are computed when this is called; the sample itself is a lazy filter. Keys may repeat:
    of a key at the cutoff as many rows are taken as are wanted, by a hash of the whole row (its columns must be
    comparable). Rows with other labels, or with a null key, are left out. ``digits`` hex digits of the order key
    form the histogram buckets (16**digits per class); it only changes how much
    work the crossing bucket's ranking gets, never the result.
    """
    if not 1 <= digits <= 6:
        raise ValueError("digits must be in 1..6")
    salt = f"{seed}:"
    rows = (df.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
            .withColumn("_h", hash_order(key, salt))
            .withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int")))
    # Histogram: at most parts × 2 × 16**digits rows. Class sizes, k per part and the
    # crossing bucket all come from windows over this small table (one pass over rows).
    hist = rows.groupBy(part_col, label, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    # Clustering the small histogram by part once satisfies every window and
    # aggregate below ((part), (part, label)) without further shuffles.
    hist = hist.repartition(part_col)
    w_cls = Window.partitionBy(part_col, label)
    w_cum = w_cls.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_part = Window.partitionBy(part_col)
    h = (hist.withColumn("_n", F.sum("_cnt").over(w_cls))
         .withColumn("_cum", F.sum("_cnt").over(w_cum))
         .withColumn("_classes", F.size(F.collect_set(label).over(w_part))))
    k = F.min("_n").over(w_part)
    if cap:
        k = F.least(k, F.lit(int(cap)).cast("bigint"))
    h = h.withColumn("k", F.when(F.col("_classes") < 2, F.raise_error(F.concat(
        F.lit("balanced sample: a class is missing in part "), F.col(part_col).cast("string")))).otherwise(k))
    crossing = (h.filter(F.col("_cum") >= F.col("k"))
                .groupBy(part_col, label)
                .agg(F.min(F.struct("_b", "_cum", "_cnt", "k")).alias("_x"))
                .select(part_col, label,
                        F.col("_x._b").alias("_bx"),
                        (F.col("_x.k") - (F.col("_x._cum") - F.col("_x._cnt"))).alias("_need")))
    # k >= 1 whenever both classes exist, so every (part, label) crosses somewhere.
    # The k-th smallest (hash, key) of a class lies in its crossing bucket at rank
    # _need; only that bucket's keys are ranked (at most parts × 2 small windows), each
    # with its number of rows, so that a key of many rows is one row here.
    edge = (rows.join(F.broadcast(crossing), [part_col, label]).filter(F.col("_b") == F.col("_bx"))
            .groupBy(part_col, label, "_h", F.col(key).alias("_kc"), "_need").agg(F.count(F.lit(1)).alias("_same")))
    ranked = Window.partitionBy(part_col, label).orderBy("_h", "_kc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("_same").over(ranked)
    cutoff = (edge.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_same") < F.col("_need")))
              .select(part_col, label, F.col("_h").alias("_hc"), "_kc", "_same", (F.col("_need") - F.col("_upto") + F.col("_same")).alias("_take")))
    cutoff = cut_lineage(cutoff)  # at most parts × 2 rows
    split = (F.col("_h") == F.col("_hc")) & (F.col(key) == F.col("_kc"))
    near = rows.join(F.broadcast(cutoff), [part_col, label])
    # Every kept row is at or below the cutoff in (hash, key) order: one narrow filter, without the keys of which only
    # some rows are taken.
    keep = (F.col("_h") < F.col("_hc")) | ((F.col("_h") == F.col("_hc")) & (F.col(key) <= F.col("_kc")))
    kept = near.filter(keep & ~(split & (F.col("_take") < F.col("_same")))).select(df.columns)
    if cutoff.where("_take < _same").isEmpty():
        return kept
    # Equal rows are counted, not ranked one by one; the first _take of the key's rows in the order of a row hash.
    some = near.filter(split & (F.col("_take") < F.col("_same"))).groupBy(*df.columns, "_take").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(part_col, label).orderBy(F.xxhash64(*df.columns), *df.columns).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_take") - F.coalesce(F.sum("_n").over(order), F.lit(0))
    some = some.withColumn("_n", F.least(F.col("_n"), left)).filter(F.col("_n") > 0)
    some = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return kept.unionByName(some.select(df.columns))


def with_shuffle_key(df: DataFrame, key: str, seed: int = 42, out_col: str = "shuffle_key") -> DataFrame:
    """The repeatable shuffle position (P6) as a column: md5 with a salt of its own (the
    sampling salt would put the kept majority rows first)."""
    return df.withColumn(out_col, hash_order(key, f"shuffle:{seed}:"))


def shuffle_order(df: DataFrame, key: str, seed: int = 42, out_col: str = "shuffle_key") -> DataFrame:
    """Repeatable shuffle (P6): rows in the order of the shuffle key, then of ``key``; use it at the sink.

    An md5 is uniform, so equal ranges of its first digits hold about the same number of rows: each row names its
    partition, no sampling pass finds bounds, and ``df`` is read once. Partitions follow each other in order and are
    sorted in themselves. Rows of one key share a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.conv(F.substring(out_col, 1, 8), 16, 10).cast("long")
    part = F.floor(F.coalesce(first, F.lit(0)) * n / F.lit(1 << 32)).cast("int")  # a null key comes first
    return with_shuffle_key(df, key, seed, out_col).repartitionById(n, part).sortWithinPartitions(out_col, key)


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per feature (P9); std 0 becomes 1.

    Null and NaN values are skipped. Returns one row ``(feature, mean, std)`` per feature, with a null mean and std 1
    for a feature without values. One pass over the table whatever its width: a task reduces its rows to vectors as
    long as the feature list (see ``moments``).
    """
    std = F.when(F.col("n") > 0, F.sqrt(F.col("m2") / F.col("n")))
    return moments(df, list(dict.fromkeys(features))).select(
        "feature", "mean", F.when((std == 0) | std.isNull(), F.lit(1.0)).otherwise(std).alias("std"))


def collect_params(params: DataFrame, max_rows: int = 100_000) -> dict[str, tuple[float, float]]:
    """Bring scaler parameters (one row per feature) to the driver. A table of more than ``max_rows`` rows is refused
    as a whole: it is not a parameter table."""
    rows = params.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"parameter table has more than {max_rows} rows; it is not a parameter table")
    return {r["feature"]: (r["mean"], r["std"]) for r in rows}


def scaler_transform(df: DataFrame, params, features: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
    """``(x - mean) / std`` with the fitted parameters as literals: a narrow projection (P10)."""
    p = params if isinstance(params, dict) else collect_params(params)
    features = list(features) if features is not None else list(p)
    scaled = {}
    for c in features:
        mean, std = p[c]
        scaled[c + suffix] = ("CAST(NULL AS DOUBLE)" if mean is None else
                              f"({sql_clean_double(c)} - {sql_double(mean)}) / {sql_double(std)}")
    # one projection written as SQL text: cheap to build and analyse for hundreds of columns
    exprs = [f"{scaled.pop(c)} AS {sql_ident(c)}" if c in scaled else sql_ident(c) for c in df.columns]
    exprs += [f"{e} AS {sql_ident(c)}" for c, e in scaled.items()]
    return df.selectExpr(*exprs)


def assemble(df: DataFrame, features: Sequence[str], out_col: str = "features") -> DataFrame:
    """Feature columns into one ``array<float>``."""
    return df.withColumn(out_col, F.array(*[F.col(c) for c in features]).cast("array<float>"))


def prepare(df: DataFrame, key: str, label: str, ts: str, cut, features: Sequence[str], cap: int | None = None,
            seed: int = 42, part_col: str = "part") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """The whole preparation (P12): split, balance each part, fit the scaler on the
    balanced train part, scale both parts, drop the date, add the shuffle key.

    Returns the prepared table ``(key, part, label, features…, shuffle_key)`` and the
    scaler parameters. Rows are not sorted: order by ``shuffle_key`` at the sink
    (``shuffle_order``), since fits and evaluations do not need the sort.
    """
    base = df.select(key, label, ts, *features)
    parts = time_split(base, ts, cut, part_col)
    # The sample feeds both the scaler fit and the transform: write it once.
    balanced = cut_lineage(drop_if_present(balanced_sample(parts, key, label, part_col, cap=cap, seed=seed), ts))
    params = collect_params(fit_scaler(balanced.filter(F.col(part_col) == TRAIN), features))
    scaled = scaler_transform(balanced, params, features)
    return with_shuffle_key(scaled, key, seed), params
