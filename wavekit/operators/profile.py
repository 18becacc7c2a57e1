"""Aggregation and profiling operators.

Plan shape for every column profile: ONE aggregate over the data (k columns × s statistics,
map-side partial aggregation, a single tiny final row), then an ``inline`` of that row into a
long table. Grouped profiles shuffle only the partial aggregates of their (few) groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavekit.functions.scalars import attach
from wavekit.operators.recode import numeric_columns
from wavekit.session import ensure_checkpoint_dir


def _long(row_df: DataFrame, entries: list[Column]) -> DataFrame:
    """One-row frame + struct per variable → long frame (one row per variable)."""
    return row_df.select(F.inline(F.array(*entries)))


def frequency_table(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: value (NULL kept as its own row), n, percent of the group."""
    by = list(by)
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.sum("n").alias("__t"))
    if not by:
        return attach(counts, total).withColumn("percent", 100.0 * F.col("n") / F.col("__t")).drop("__t")
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
    return counts.join(total, same).select(*counts.columns, (100.0 * F.col("n") / F.col("__t")).alias("percent"))


def value_counts(df: DataFrame, col: str, normalize: bool = False, top: int | None = None) -> DataFrame:
    """Counts (or shares) per value, largest first, value as tie key; optional top-k."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        total = out.agg(F.sum("n").alias("__t"))
        out = attach(out, total).withColumn("share", F.col("n") / F.col("__t")).drop("__t")
    if top is not None:
        out = out.orderBy(F.desc("n"), F.asc_nulls_last(col)).limit(top)
    return out


def dataset_summary(df: DataFrame, by: str, categorical: Sequence[str] | None = None) -> DataFrame:
    """Per source: rows, columns, numeric and categorical column counts, missing cells."""
    cols = [c for c in df.columns if c != by]
    num = set(numeric_columns(df, exclude=[by]))
    n_cat = len([c for c in cols if c not in num]) if categorical is None else len(categorical)
    missing = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(cols)).alias("n_columns"),
        F.lit(len(num)).alias("n_numeric"),
        F.lit(n_cat).alias("n_categorical"),
        F.sum(missing).alias("n_missing_cells"),
    )


def column_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, variable, value, n): how often each numeric column has each value (null: none). All columns are
    stacked into one partially aggregated group-by; the result is written to the checkpoint folder, as what is
    derived from it (quantiles, distinct counts, modes) reads it several times."""
    values = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])
    stacked = df.select(*by, F.explode(values).alias("__s")).select(*by, "__s.variable", "__s.value")
    counts = stacked.where("value is not null").groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    ensure_checkpoint_dir(df.sparkSession)
    return counts.checkpoint()


def column_quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by…, variable, prob, value): exact quantiles of every column of a ``column_counts`` table. ``by`` has few groups
    (imputations, waves)."""
    keys = [*by, "variable"]
    return _quantiles(counts.select(*keys, F.col("value").alias("__v"), F.col("n").alias("__c")), probs, keys, few=True)


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column."""
    q = column_quantiles(column_counts(df, cols), [0.5])
    return q.agg(*[F.max(F.when(F.col("variable") == c, F.col("value"))).alias(c) for c in cols])


def column_modes(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, variable, mode): the most frequent value, the smallest of several."""
    best = F.max(F.struct("n", (-F.col("value")).alias("v")))
    return counts.groupBy(*by, "variable").agg(best.alias("__b")).select(*by, "variable", (-F.col("__b.v")).alias("mode"))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, position, n_distinct) of columns of any type: one stacked group-by, then a count; columns without
    a value have 0."""
    values = F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    stacked = df.select(F.explode(values).alias("__s")).select("__s.position", "__s.value").where("value is not null")
    n = stacked.distinct().groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "position int, variable string")
    return names.join(n, "position", "left").select("variable", "position", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """describe() + distinct count per column: count, mean, std (ddof 1), min, q25, median, q75, max, n_distinct.
    Moments come from one wide aggregate, exact quartiles and distinct counts from the column counts."""
    row = df.agg(*[
        f(F.col(c).cast("double")).alias(f"{c}__{k}")
        for c in cols
        for k, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ])
    moments = _long(row, [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{k}").alias(k) for k in ("count", "mean", "std", "min", "max")]) for c in cols
    ])
    counts = column_counts(df, cols)
    q = column_quantiles(counts, [0.25, 0.5, 0.75]).groupBy("variable").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(k) for p, k in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
    ])
    nd = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("n_distinct"))
    out = moments.join(q, "variable", "left").join(nd, "variable", "left")
    names = ("variable", "count", "mean", "std", "min", "q25", "median", "q75", "max")
    return out.select(*names, F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """rows, distinct rows and duplicates (rows − distinct rows) over ``cols``."""
    cols = list(cols) if cols is not None else df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(
        F.sum("__n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_rows"),
        F.sum(F.col("__n") - 1).alias("n_duplicates"),
    )


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True,
                    impute_band: tuple[float, float] = (0.0, 10.0)) -> DataFrame:
    """Per column: n_missing, pct_missing (2 dp), impute_target (lo < pct < hi); one wide aggregate."""
    cols = list(cols) if cols is not None else df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    out = _long(
        row,
        [F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_missing"), F.col("__n").alias("n_rows")) for c in cols],
    )
    pct = 100.0 * F.col("n_missing") / F.col("n_rows")
    lo, hi = impute_band
    out = out.withColumn("pct_missing", F.round(pct, 2)).withColumn(
        "impute_target", (pct > lo) & (pct < hi)
    )
    if only_missing:
        out = out.where(F.col("n_missing") > 0)
    return out.drop("n_rows")


def negative_counts(df: DataFrame, cols: Sequence[str] | None = None, only_positive: bool = True) -> DataFrame:
    """Negatives per numeric column (one wide aggregate)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])
    out = _long(row, [F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_negative")) for c in cols])
    return out.where(F.col("n_negative") > 0) if only_positive else out


def outlier_counts(df: DataFrame, cols: Sequence[str], k: float = 3.0, only_positive: bool = True) -> DataFrame:
    """Rows outside mean ± k·sd (ddof 1) per column: a stats pass, then a count pass."""
    stats = df.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_samp(c).alias(f"{c}__s") for c in cols])
    joined = attach(df.select(*cols), stats)  # one stats row
    row = joined.agg(
        *[
            F.count_if(F.abs(F.col(c) - F.col(f"{c}__m")) > k * F.col(f"{c}__s")).alias(c)
            for c in cols
        ]
    )
    out = _long(row, [F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_outliers")) for c in cols])
    return out.where(F.col("n_outliers") > 0) if only_positive else out


def prevalence_by(df: DataFrame, y: str, by: Sequence[str], z: float = 1.96, weight: str | None = None) -> DataFrame:
    """Mean of a 0/1 outcome by group with n, sd (ddof 1), se = sd/√n and mean ± z·se."""
    by = list(by)
    yv = F.col(y)
    if weight:
        agg = df.where(yv.isNotNull() & F.col(weight).isNotNull()).groupBy(*by).agg(
            (F.sum(F.col(weight) * yv) / F.sum(weight)).alias("prevalence"),
            F.count(yv).alias("n"),
            F.stddev_samp(yv).alias("sd"),
        )
    else:
        agg = df.groupBy(*by).agg(F.avg(yv).alias("prevalence"), F.count(yv).alias("n"), F.stddev_samp(yv).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    return agg.withColumn("se", se).withColumn("ci_lower", F.col("prevalence") - z * se).withColumn(
        "ci_upper", F.col("prevalence") + z * se
    )


def suppress_small_cells(df: DataFrame, n_col: str, cols: Sequence[str], min_n: int = 5) -> DataFrame:
    """Null out group results whose cell count is below ``min_n`` (data-use rule); rows are kept."""
    keep = F.col(n_col) >= min_n
    return df.withColumns({c: F.when(keep, F.col(c)) for c in cols}).withColumn("suppressed", ~keep)


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles, one row per probability: with pos = (n − 1)·p, k = ⌊pos⌋, the value is interpolated between
    the k-th and (k+1)-th order statistics.

    Plan: distinct values with counts per group (partial aggregation) → bucketed cumulative counts → each distinct
    value is tested against the |probs| target positions → one small aggregate per (group, prob). Memory is
    bounded by a bucket of distinct values.
    """
    x = F.col(col).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*by, x.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    return _quantiles(counts, probs, list(by))


def _quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str], few: bool = False) -> DataFrame:
    from wavekit.operators.evaluate import cumulative_counts, with_group

    if by:
        totals = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
        cum = with_group(cumulative_counts(counts, "__v", ["__c"], by=by, few=few), totals, by, few)
    else:
        cum = attach(cumulative_counts(counts, "__v", ["__c"]), counts.agg(F.sum("__c").alias("__n")))
    rows = cum.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    pos = (F.col("__n") - 1).cast("double") * F.col("prob")
    k = F.floor(pos)
    start, end = F.col("__c_before"), F.col("__c_before") + F.col("__c")
    is_lo = (start <= k) & (k < end)
    is_hi = (start <= k + 1) & (k + 1 < end)
    hit = rows.where(is_lo | is_hi).select(
        *by, "prob", (pos - k).alias("__d"),
        F.when(is_lo, F.col("__v")).alias("__lo"), F.when(is_hi, F.col("__v")).alias("__hi"),
    )
    g = hit.groupBy(*by, "prob").agg(F.max("__lo").alias("lo"), F.max("__hi").alias("hi"), F.max("__d").alias("d"))
    value = F.when(F.col("hi").isNull() | (F.col("d") == 0), F.col("lo")).otherwise(
        F.col("lo") * (1 - F.col("d")) + F.col("hi") * F.col("d")
    )
    return g.select(*by, "prob", value.alias("value"))


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), optionally per class: bin, lo, hi, n."""
    by = list(by)
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("__lo")) / width), F.lit(bins - 1))
    ).cast("int")
    binned = attach(df.where(x.isNotNull()), rng).withColumn("bin", b)
    out = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi")
    )
    w = (F.col("__hi") - F.col("__lo")) / bins
    return out.withColumn("lo", F.col("__lo") + F.col("bin") * w).withColumn(
        "hi", F.col("__lo") + (F.col("bin") + 1) * w
    ).drop("__lo", "__hi")


def imputation_compare(stack: DataFrame, cols: Sequence[str], imp_col: str = "imp") -> DataFrame:
    """Per imputation and variable: mean, sd, min, median, max, mode (smallest of ties)."""
    stats = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    wide = stack.groupBy(imp_col).agg(*[f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in cols for k, f in stats.items()])
    moments = wide.select(
        imp_col,
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{c}__{k}").alias(k) for k in stats]) for c in cols])),
    )
    counts = column_counts(stack, cols, by=[imp_col])
    keys = [imp_col, "variable"]
    medians = column_quantiles(counts, [0.5], by=[imp_col]).select(*keys, F.col("value").alias("median"))
    out = moments.join(medians, keys, "left").join(column_modes(counts, by=[imp_col]), keys, "left")
    return out.select(*keys, "mean", "sd", "min", "median", "max", "mode")


def minmax_metrics(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Rescale metric columns of a (small) model table to 0–1."""
    w = Window.partitionBy()
    return df.withColumns(
        {
            f"{c}{suffix}": (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))
            for c in cols
        }
    )


def mean_sd_curve(df: DataFrame, size_col: str, score_col: str) -> DataFrame:
    """Mean and population sd (ddof 0) of scores per training size."""
    return df.groupBy(size_col).agg(
        F.avg(score_col).alias("mean_score"), F.stddev_pop(score_col).alias("sd_score"), F.count(score_col).alias("n")
    )


def robustness_summary(df: DataFrame, score_col: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, sd (ddof 1), min, max, range, 2.5 % and 97.5 % of a score list."""
    x = F.col(score_col)
    return df.groupBy(*by).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        (F.max(x) - F.min(x)).alias("range"),
        F.percentile(x, 0.025).alias("q025"),
        F.percentile(x, 0.975).alias("q975"),
        F.count(x).alias("n"),
    )


def diff_from_first(df: DataFrame, value_col: str, order_col: str, dst: str = "diff_from_first") -> DataFrame:
    """Difference of each row from the first row in ``order_col`` order (small result tables)."""
    w = Window.orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(dst, F.col(value_col) - F.first(value_col).over(w))
