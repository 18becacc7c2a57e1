"""Feature preparation: type inference, simple imputation, scaling, one-hot, pair expansion.

Fit-type operators return a small parameter DataFrame (one row per column or level) and an
``apply`` that joins/broadcasts it back; fitting is one aggregate pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavekit.functions.scalars import attach
from wavekit.operators.profile import column_medians, distinct_counts
from wavekit.operators.recode import NUMERIC


def infer_feature_types(df: DataFrame, cols: Sequence[str], max_levels: int = 20) -> DataFrame:
    """variable, n_distinct (exact), kind: string/bool columns or ≤ ``max_levels`` distinct values are categorical.

    One stacked group-by for all columns.
    """
    is_num = lambda c: isinstance(df.schema[c].dataType, NUMERIC) and not isinstance(df.schema[c].dataType, T.BooleanType)
    numeric = F.col("variable").isin([c for c in cols if is_num(c)]) & (F.col("n_distinct") > max_levels)
    kind = F.when(numeric, "numeric").otherwise("categorical")
    return distinct_counts(df, cols).select("variable", "n_distinct", kind.alias("kind"))


def varying_columns(df: DataFrame, ordered_cols: Sequence[str], k: int = 10) -> DataFrame:
    """Features with ≥ 2 distinct non-null values, kept in the given (importance) order, first ``k``."""
    return distinct_counts(df, ordered_cols).where(F.col("n_distinct") >= 2).orderBy("position").limit(k)


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, with_mean: bool = True, stats_from: DataFrame | None = None,
                suffix: str = "") -> DataFrame:
    """(x − mean)/sd with population sd (ddof 0) by default; ``with_mean=False`` scales only (sparse use).
    Statistics come from ``stats_from`` (the training rows) when given: one aggregate, one broadcast row."""
    src = stats_from if stats_from is not None else df
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = src.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[sd(c).alias(f"__s_{c}") for c in cols])
    out = attach(df, stats)
    for c in cols:
        centred = F.col(c) - F.col(f"__m_{c}") if with_mean else F.col(c)
        out = out.withColumn(f"{c}{suffix}", centred / F.col(f"__s_{c}"))
    return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])


#: Levels that become one column each, at most; a column with more needs ``preprocess_pipeline``'s sparse slots.
MAX_LEVELS = 1000


def onehot(df: DataFrame, col: str, fit_on: DataFrame | None = None, drop_first: bool = False,
           prefix: str | None = None, max_levels: int = MAX_LEVELS) -> tuple[DataFrame, list]:
    """0/1 columns for the levels seen in ``fit_on`` (sorted); a level unseen at fit time gives all zeros.
    Returns (frame, levels). The levels name the columns, so they come to the driver: at most ``max_levels``, more
    raise."""
    src = fit_on if fit_on is not None else df
    found = src.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels; use preprocess_pipeline (sparse slots)")
    levels = sorted(r[0] for r in found)
    used = levels[1:] if drop_first else levels
    prefix = prefix if prefix is not None else f"{col}_"
    out = df.withColumns({f"{prefix}{lv}": F.coalesce((F.col(col) == F.lit(lv)).cast("int"), F.lit(0)) for lv in used})
    return out, levels


def poly_interactions(df: DataFrame, cols: Sequence[str], sep: str = "__x__") -> DataFrame:
    """All pairwise products xᵢ·xⱼ (i < j), no squares, as columns."""
    cols = list(cols)
    return df.withColumns({f"{a}{sep}{b}": F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i + 1:]})


def _expansion_terms(last: int, degree: int) -> list[tuple[int, ...]]:
    """Slots of the terms of a polynomial expansion in the order in which it lists them: by the power of the last slot,
    for each power all terms of the slots before it."""
    if degree == 0 or last < 0:
        return [()]
    return [t + (last,) * i for i in range(degree + 1) for t in _expansion_terms(last - 1, degree - i)]


def poly_vector(df: DataFrame, slots: int, input_col: str = "features", output_col: str = "features", degree: int = 2) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """All slots of a vector and their products of up to ``degree`` different slots (i < j < …), no powers, as one vector
    (sparse stays sparse: a row has terms of its non-zero slots only). Returns (frame, the slots of each term); degree 3
    gives slots + slots · (slots − 1) / 2 + slots · (slots − 1) · (slots − 2) / 6 terms."""
    from pyspark.ml.feature import PolynomialExpansion, VectorSlicer

    terms = _expansion_terms(slots - 1, degree)[1:]
    kept = [k for k, t in enumerate(terms) if len(set(t)) == len(t)]
    wide = PolynomialExpansion(degree=degree, inputCol=input_col, outputCol="__poly").transform(df)
    if output_col in wide.columns:
        wide = wide.drop(output_col)
    out = VectorSlicer(inputCol="__poly", outputCol=output_col, indices=kept).transform(wide).drop("__poly")
    return out, [terms[k] for k in kept]


def cross_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-empty cells of every level pair (fᵢ = a, fⱼ = b): which pairwise dummy products are non-zero
    anywhere, with counts (one ``groupBy`` per pair via a stacked key)."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    stacked = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("f1"), F.col(a).cast("string").alias("v1"), F.lit(b).alias("f2"),
                             F.col(b).cast("string").alias("v2"))
                    for a, b in pairs
                ]
            )
        )
    )
    return stacked.groupBy("f1", "v1", "f2", "v2").agg(F.count(F.lit(1)).alias("n"))


def preprocess_pipeline(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], output_col: str = "features"):
    """Spark ML pipeline: numeric → median impute → standardise (ddof 0 via mean/scale from the train rows);
    categorical → index (unseen kept as an extra index) → one-hot with all levels → one assembled vector.

    Returns (PipelineModel, slot metadata DataFrame (slot, base_feature, kind)). Exact median fill and ddof-0
    scaling are applied as column expressions before the ML stages, because ``ml.feature.Imputer`` uses an
    approximate median and ``StandardScaler`` uses ddof 1.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler

    numeric, categorical = list(numeric), list(categorical)
    medians = column_medians(train, numeric).first()
    stats = train.agg(
        *[F.avg(F.col(c)).alias(f"mean_{c}") for c in numeric],
        *[F.stddev_pop(F.col(c)).alias(f"sd_{c}") for c in numeric],
    ).first()
    exprs = []
    for c in numeric:
        med, mean, sd = medians[c], stats[f"mean_{c}"], stats[f"sd_{c}"] or 1.0
        # fill from the exact train median, then centre/scale with the train mean and population sd
        exprs.append(f"(coalesce(CAST({c} AS DOUBLE), {med!r}) - {mean!r}) / {sd!r} AS __num_{c}")
    sql = "SELECT *" + "".join(f", {e}" for e in exprs) + " FROM __THIS__"
    stages = [SQLTransformer(statement=sql)]
    cat_cols = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"__idx_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"__idx_{c}", outputCol=f"__oh_{c}", dropLast=True, handleInvalid="error"))
        cat_cols.append(f"__oh_{c}")
    stages.append(VectorAssembler(inputCols=[f"__num_{c}" for c in numeric] + cat_cols, outputCol=output_col))
    model = Pipeline(stages=stages).fit(train)
    spark = train.sparkSession
    slots = [(c, c, "numeric") for c in numeric]
    idx_models = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"]
    for c, im in zip(categorical, idx_models):
        for lv in im.labels:
            slots.append((f"{c}={lv}", c, "categorical"))
    meta = spark.createDataFrame(
        [(i, s, b, k) for i, (s, b, k) in enumerate(slots)], "slot_index int, slot string, base_feature string, kind string"
    )
    return model, meta


def model_matrix(df: DataFrame, formula: str, label_col: str = "label", features_col: str = "features") -> DataFrame:
    """Full dummy expansion of a frame by an R-style formula (``RFormula``)."""
    from pyspark.ml.feature import RFormula

    rf = RFormula(formula=formula, featuresCol=features_col, labelCol=label_col, handleInvalid="keep")
    return rf.fit(df).transform(df)
