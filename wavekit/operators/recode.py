"""Projection, recode and predicate operators.

All of them are narrow transformations (no shuffle): they compile into the scan's
whole-stage-codegen span and let Catalyst push row filters into the parquet reader.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.functions.scalars import attach

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# ---------------------------------------------------------------- codes and nulls


def sentinel_to_null(df: DataFrame, sentinels: Sequence[int] = (-9, -8), subset: Iterable[str] | None = None) -> DataFrame:
    """Coded missing values (−9/−8 by default) become SQL NULL in every numeric column of ``subset``."""
    cols = set(subset) if subset is not None else set(numeric_columns(df))
    return df.select(
        *[
            F.when(F.col(f.name).isin(list(sentinels)), F.lit(None).cast(f.dataType))
            .otherwise(F.col(f.name))
            .alias(f.name)
            if f.name in cols and isinstance(f.dataType, NUMERIC)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def dichotomize(df: DataFrame, src: str, dst: str | None = None, coding: str = "first_use", drop_src: bool = True) -> DataFrame:
    """Outcome code to 0/1/NULL (double).

    ``first_use``: 1 → 0, ≥ 2 → 1, anything else NULL (the default coding).
    ``frequency``: 1..6 → 1, 7 → 0, anything else NULL (the alternative coding).
    """
    x = F.col(src)
    if coding == "first_use":
        out = F.when(x == 1, F.lit(0.0)).when(x >= 2, F.lit(1.0))
    elif coding == "frequency":
        out = F.when(x.between(1, 6), F.lit(1.0)).when(x == 7, F.lit(0.0))
    else:
        raise ValueError(f"unknown coding {coding!r}")
    dst = dst or f"{src}d"
    df = df.withColumn(dst, out.cast("double"))
    return df.drop(src) if drop_src and dst != src else df


def recode_map(
    df: DataFrame,
    src: str,
    mapping: Mapping,
    dst: str | None = None,
    default=None,
    passthrough: bool = False,
    drop_src: bool = True,
) -> DataFrame:
    """Value map generated into one CASE chain; unmapped values become ``default`` (NULL) or pass through."""
    x = F.col(src)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(x == k, F.lit(v))) if expr is None else expr.when(x == k, F.lit(v))
    fallback = x if passthrough else F.lit(default)
    expr = fallback if expr is None else expr.otherwise(fallback)
    dst = dst or src
    out_type = df.schema[src].dataType if passthrough else None
    if out_type is None and mapping:
        sample = next(iter(mapping.values()))
        out_type = T.IntegerType() if isinstance(sample, (int, bool)) and not isinstance(sample, float) else None
    df = df.withColumn(dst, expr.cast(out_type) if out_type is not None else expr)
    return df.drop(src) if drop_src and dst != src else df


def indicator(df: DataFrame, src: str, value, dst: str) -> DataFrame:
    """0/1 indicator of equality (e.g. ``female = (sex == 2)``); NULL stays NULL."""
    return df.withColumn(dst, (F.col(src) == value).cast("int"))


def filter_complete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion on ``subset`` (all columns when None)."""
    return df.dropna(how="any", subset=list(subset) if subset is not None else None)


def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop listed columns; names that are absent are ignored."""
    return df.drop(*list(cols))


# ---------------------------------------------------------------- harmonise sources


def harmonize_outcome(frames: Mapping[str, DataFrame], outcome_by_source: Mapping[str, str], target: str) -> dict[str, DataFrame]:
    """Per-source outcome column → one common name; the source column is replaced."""
    out = {}
    for name, df in frames.items():
        src = outcome_by_source.get(name)
        if src is not None and src in df.columns and src != target:
            df = df.withColumnRenamed(src, target)
        out[name] = df
    return out


def add_grade(df: DataFrame, form_col: str = "form", grade_col: str | None = None, fixed_grade: int = 12,
              form_with_grade: str = "0810", dst: str = "grade") -> DataFrame:
    """Form with a grade question copies it; the senior form gets the literal grade."""
    copied = F.col(grade_col) if grade_col else F.lit(None)
    return df.withColumn(
        dst, F.when(F.col(form_col) == form_with_grade, copied).otherwise(F.lit(fixed_grade)).cast("int")
    )


def add_wave(df: DataFrame, name_col: str, dst: str = "wave", century: int = 2000) -> DataFrame:
    """Survey year from a source name: a 4-digit year is taken as is, a 2-digit one gets ``century`` added."""
    four = F.regexp_extract(F.col(name_col), r"((?:19|20)\d{2})", 1)
    two = F.regexp_extract(F.col(name_col), r"[A-Za-z](\d{2})_", 1)
    wave = F.when(four != "", four.cast("int")).when(two != "", two.cast("int") + century)
    return df.withColumn(dst, wave.cast("int"))


def add_race(df: DataFrame, column_by_form: Mapping[str, str], form_col: str = "form", dst: str = "race") -> DataFrame:
    """Pick the race column by form."""
    chain = None
    for form, src in column_by_form.items():
        cond = F.col(form_col) == form
        chain = F.when(cond, F.col(src)) if chain is None else chain.when(cond, F.col(src))
    return df.withColumn(dst, chain)


# ---------------------------------------------------------------- names and labels


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Code → descriptive name; absent codes are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def label_lookup(df: DataFrame, labels: DataFrame, key: str = "variable", label_col: str = "label",
                 dst: str = "display") -> DataFrame:
    """Display label from a (key, label) dimension table, falling back to the code.

    The label table is a dimension (one row per variable code); Spark broadcasts it when its
    size estimate is under the broadcast threshold and sort-merges otherwise.
    """
    lab = labels.select(F.col(key).alias("__k"), F.col(label_col).alias("__lab"))
    return (
        df.join(lab, F.col(key) == F.col("__k"), "left")
        .withColumn(dst, F.coalesce(F.col("__lab"), F.col(key)))
        .drop("__k", "__lab")
    )


def sanitize_labels(df: DataFrame, col: str, dst: str | None = None, prefix: str = "C") -> DataFrame:
    """Class labels usable as identifiers: '-' → 'neg', then a prefix."""
    return df.withColumn(dst or col, F.concat(F.lit(prefix), F.regexp_replace(F.col(col).cast("string"), "-", "neg")))


# ---------------------------------------------------------------- derived terms


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x − mean)/sd with sd ddof=1. One aggregate pass produces a single stats row, cross-joined back."""
    stats = df.agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols]
    )
    out = attach(df, stats)  # exactly one row
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"))
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


def interaction_terms(df: DataFrame, pairs: Sequence[tuple[str, str]], sep: str = "_x_") -> DataFrame:
    """Products of column pairs."""
    return df.withColumns({f"{a}{sep}{b}": F.col(a) * F.col(b) for a, b in pairs})


def period_terms(df: DataFrame, wave_col: str = "wave", break_at: int = 1998, prefix: str = "") -> DataFrame:
    """post = wave > b, time = wave − b, post·time."""
    w = F.col(wave_col)
    post = (w > break_at).cast("int")
    return df.withColumns(
        {
            f"{prefix}post": post,
            f"{prefix}time": (w - break_at).cast("int"),
            f"{prefix}post_time": (post * (w - break_at)).cast("int"),
        }
    )


def dummies(df: DataFrame, col: str, levels: Sequence, prefix: str | None = None, contains: bool = False) -> DataFrame:
    """0/1 columns by level; ``contains=True`` matches a case-insensitive substring instead of equality."""
    prefix = prefix if prefix is not None else f"{col}_"
    x = F.col(col)
    new = {}
    for lv in levels:
        name = f"{prefix}{str(lv).lower().replace(' ', '_')}"
        cond = F.lower(x.cast("string")).contains(str(lv).lower()) if contains else (x == lv)
        new[name] = F.coalesce(cond.cast("int"), F.lit(0)) if contains else cond.cast("int")
    return df.withColumns(new)


def ordered_category(df: DataFrame, col: str, order: Sequence, dst: str | None = None) -> DataFrame:
    """Position of the value in a given level order (1-based), NULL for others."""
    chain = None
    for i, lv in enumerate(order, start=1):
        chain = F.when(F.col(col) == lv, F.lit(i)) if chain is None else chain.when(F.col(col) == lv, F.lit(i))
    return df.withColumn(dst or f"{col}_order", chain.cast("int"))


def missing_indicators(df: DataFrame, cols: Sequence[str] | None = None, only_with_nulls: bool = False,
                       prefix: str = "missing_") -> DataFrame:
    """``missing_<c>`` 0/1 columns, for all ``cols`` or only those that contain a null (one aggregate pass)."""
    cols = list(cols) if cols is not None else df.columns
    if only_with_nulls:
        row = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
        cols = [c for c in cols if row[c] == 1]
    return df.withColumns({f"{prefix}{c}": F.col(c).isNull().cast("int") for c in cols})


def weight_normalize(df: DataFrame, weight_col: str = "survey_weight", dst: str | None = None) -> DataFrame:
    """Missing weights take the mean weight; then w·n/Σw so the weights sum to n.

    After mean filling Σw = n·mean, so the rescaled weight is coalesce(w, mean)/mean: one
    aggregate pass, one stats row broadcast back.
    """
    stats = df.agg(F.avg(weight_col).alias("__wm"))
    out = attach(df, stats)
    return out.withColumn(dst or weight_col, F.coalesce(F.col(weight_col), F.col("__wm")) / F.col("__wm")).drop("__wm")


def target_encode(df: DataFrame, col: str, dst: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct values → codes 0..k−1 on the typed value. Returns (encoded frame, mapping).

    The mapping holds one row per class. Codes come from a running total over the range-sorted distinct values, so a
    column with very many values is no single task's window either.
    """
    from wavekit.functions.ordering import running_total
    from wavekit.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    values = df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    mapping = running_total(values.withColumn("__one", F.lit(1).cast("long")), ["value"], "__one", "code")
    mapping = mapping.select("value", F.col("code").cast("int").alias("code"))
    out = df.join(mapping, F.col(col) == F.col("value"), "left").drop("value")
    out = out.withColumnRenamed("code", dst or f"{col}_code")
    return out, mapping


# ---------------------------------------------------------------- verbal bands


def classify_effect(df: DataFrame, or_col: str = "odds_ratio", large: float = 1.15, medium: float = 1.05,
                    small: float = 1.01) -> DataFrame:
    """Direction and size band of an odds ratio, using max(OR, 1/OR)."""
    o = F.col(or_col)
    mag = F.greatest(o, 1.0 / o)
    return df.withColumns(
        {
            "direction": F.when(o > 1, "Increases risk").when(o < 1, "Decreases risk").otherwise("No effect"),
            "effect_size": F.when(mag > large, "Large")
            .when(mag > medium, "Medium")
            .when(mag > small, "Small")
            .otherwise("Trivial"),
        }
    )


def sig_stars(df: DataFrame, p_col: str = "p_value", or_col: str | None = "odds_ratio", lo_col: str = "ci_lower",
              hi_col: str = "ci_upper") -> DataFrame:
    """'***' p<0.001, '**' p<0.01, '*' p<0.05; 'OR [lo, hi]***' text; p text ('<0.001' or 3 dp)."""
    p = F.col(p_col)
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    out = df.withColumn("stars", stars)
    out = out.withColumn("p_text", F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", F.round(p, 3))))
    if or_col:
        out = out.withColumn(
            "or_text",
            F.format_string(
                "%.2f [%.2f, %.2f]%s", F.round(F.col(or_col), 2), F.round(F.col(lo_col), 2), F.round(F.col(hi_col), 2),
                F.col("stars"),
            ),
        )
    return out


def assess_threshold(df: DataFrame, col: str, bands: Sequence[tuple[float, str]], otherwise: str, dst: str = "assessment",
                     use_abs: bool = False) -> DataFrame:
    """Numeric → verbal band: first band whose upper bound (exclusive) exceeds the value."""
    x = F.abs(F.col(col)) if use_abs else F.col(col)
    chain = None
    for bound, text in bands:
        chain = F.when(x < bound, text) if chain is None else chain.when(x < bound, text)
    return df.withColumn(dst, chain.otherwise(otherwise) if chain is not None else F.lit(otherwise))


def resolve_columns(df: DataFrame, requested: Sequence[str | Sequence[str]]) -> tuple[list[str], list[str]]:
    """Keep requested columns that exist; a tuple entry means 'first present of these candidates'.

    Returns (present, missing). Schema-only: no job runs.
    """
    have = set(df.columns)
    present, missing = [], []
    for r in requested:
        cands = [r] if isinstance(r, str) else list(r)
        hit = next((c for c in cands if c in have), None)
        (present if hit else missing).append(hit or cands[0])
    return present, missing
