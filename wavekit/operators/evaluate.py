"""Discrimination and calibration metrics on scored rows (label, score, pred).

Exact AUC / ROC without a global single-partition window:
  1. collapse rows to distinct scores with per-score counts (map-side partial aggregation);
  2. cut the distinct scores into ~equal buckets by approximate-quantile boundaries (``Bucketizer``,
     a JVM binary search) — exactness does not depend on the boundaries, only balance does;
  3. bucket totals (one row per bucket) → running offsets on that tiny table → broadcast back;
  4. cumulative counts inside each bucket with a window partitioned by bucket.
The same machinery gives exact average ranks (see ``cumulative_counts``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavekit.functions.scalars import attach
from wavekit.session import saved


#: Upper limits of the drop in AUC and their names.
BANDS = ((0.03, "Excellent"), (0.05, "Good"), (0.10, "Moderate"), (None, "Significant"))


def with_group(rows: DataFrame, groups: DataFrame, by: Sequence[str], few: bool = False) -> DataFrame:
    """``rows`` with the columns of their group's row in ``groups``, which has every group; rows with a null in ``by`` fall
    out. A left join, as Spark expects exploded rows to be no larger than the table they came from, and an inner join may
    then send all of them through the driver: here only ``groups`` can be broadcast. ``few``: it always is."""
    whole = reduce(lambda x, y: x & y, [F.col(b).isNotNull() for b in by])
    return rows.where(whole).join(F.broadcast(groups) if few else groups, list(by), "left")


def cumulative_counts(counts: DataFrame, key: str, cols: Sequence[str], buckets: int | None = None,
                      descending: bool = False, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """For a table with one row per distinct ``key`` (per group of ``by``) and count columns ``cols``, add
    ``<c>_before`` = Σ c over keys strictly before this key in the same group (ascending or descending).

    Balanced without a single-task window: approximate-quantile boundaries (global, or per group — a
    groups × buckets table) cut each group's keys into buckets; bucket totals give offsets through a window
    over the small (group, bucket) table; cumulative sums run in windows partitioned by (group, bucket).
    Exactness never depends on the boundaries, only the balance does. ``few``: groups × buckets are few, whatever the rows;
    their tables are broadcast and the counts are shuffled once."""
    from pyspark.ml.feature import Bucketizer

    by = list(by)
    spark = counts.sparkSession
    nb = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    k = F.col(key).cast("double")
    keyed = counts.withColumn("__k", k)
    probs = [i / nb for i in range(1, nb)]
    if not by:
        bounds = []
        if nb > 1:
            row = counts.agg(F.percentile_approx(k, probs, 10000).alias("b")).first()
            bounds = sorted(set(float(v) for v in (row["b"] or []) if v is not None))
        splits = [float("-inf")] + bounds + [float("inf")]
        bucketed = Bucketizer(splits=splits, inputCol="__k", outputCol="__b").transform(keyed)
    elif nb > 1:
        edges = counts.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(k, probs, 10000))).alias("__edges"))
        # how many edges are not above the key, by halving steps; groups without a key have no edges and fall out
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(nb.bit_length()))])
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("__edges", at + step - 1) <= F.col("__k"), at + step).otherwise(at))
        bucketed = with_group(keyed, edges, by, few).withColumn("__b", F.when(F.col("__edges").isNotNull(), below.cast("double"))).drop("__edges")
    else:
        bucketed = keyed.withColumn("__b", F.lit(0.0))
    if descending:
        bucketed = bucketed.withColumn("__b", -F.col("__b"))
    totals = bucketed.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    wtot = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # groups × buckets rows
    offsets = totals.select(
        *by, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(wtot), F.lit(0)).alias(f"__o_{c}") for c in cols]
    )
    order = F.col("__k").desc() if descending else F.col("__k").asc()
    win = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = with_group(bucketed, offsets, [*by, "__b"], few or not by)
    return out.select(
        *[c for c in counts.columns],
        *[(F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(win), F.lit(0))).alias(f"{c}_before") for c in cols],
    )


def score_counts(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """(score, pos, neg) per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    return (
        df.where(y.isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(y == 1, 0).otherwise(w)).alias("neg"))
    )


def _auc() -> Column:
    """Null where a group has one class only."""
    pairs = F.sum("pos") * F.sum("neg")
    return F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))) / F.when(pairs > 0, pairs)


def roc_auc(df: DataFrame, label: str = "label", score: str = "prob", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Mann–Whitney AUC with ties counted ½: Σ pos(s)·(neg below s + ½·neg(s)) / (P·N). One row (per group). ``weight``:
    a column of counts."""
    w = F.col(weight) if weight else F.lit(1)
    if by:
        # grouped variant (models, folds, periods): per-group bucketed cumulative counts
        y = F.col(label)
        counts = (
            df.where(y.isNotNull() & F.col(score).isNotNull())
            .groupBy(*by, F.col(score).alias("score"))
            .agg(F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(y == 1, 0).otherwise(w)).alias("neg"))
        )
        counts = saved(counts)
        cum = cumulative_counts(counts, "score", ["neg"], by=list(by))
        return cum.groupBy(*by).agg(
            _auc().alias("auc"),
            F.sum("pos").cast("long").alias("n_pos"),
            F.sum("neg").cast("long").alias("n_neg"),
        )
    counts = saved(score_counts(df, label, score, weight))  # scores are read several times, scoring happens once
    cum = cumulative_counts(counts, "score", ["neg"])
    return cum.agg(
        _auc().alias("auc"),
        F.sum("pos").cast("long").alias("n_pos"),
        F.sum("neg").cast("long").alias("n_neg"),
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score: share of negatives / positives with score ≥ threshold."""
    counts = saved(score_counts(df, label, score))
    cum = cumulative_counts(counts, "score", ["pos", "neg"], descending=True)
    tot = counts.agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    return attach(cum, tot).select(
        F.col("score").alias("threshold"),
        ((F.col("neg_before") + F.col("neg")) / F.col("__N")).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / F.col("__P")).alias("tpr"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred", normalize: bool = False) -> DataFrame:
    """(label, pred, n[, share of the label's row])."""
    out = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        out = out.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))
    return out


def class_metrics(df: DataFrame, label: str = "label", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """Per class: precision, recall, F1, support (zero division → 0); plus accuracy and support-weighted
    averages as class 'weighted' and 'accuracy' rows. Computed from the confusion counts (``weight``: a column of counts)."""
    cm = df.groupBy(F.col(label).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n")
    )
    classes = cm.select(F.col("t").alias("cls")).union(cm.select(F.col("p").alias("cls"))).distinct()
    per = (
        classes.join(cm, F.col("t") == F.col("cls"), "left")
        .groupBy("cls")
        .agg(
            F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("support"),
        )
    )
    pred_tot = cm.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = per.join(pred_tot, "cls", "left").fillna(0, ["predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("precision", prec).withColumn("recall", rec)
    per = per.withColumn(
        "f1",
        F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0),
    )
    per = per.select(
        F.col("cls").alias("class"), "precision", "recall", "f1", F.col("support").cast("long").alias("support")
    )
    tot = per.agg(
        F.sum("support").alias("__s"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
    )
    weighted = tot.select(F.lit("weighted").alias("class"), "precision", "recall", "f1",
                          F.col("__s").cast("long").alias("support"))
    acc = per.agg((F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("a"),
                  F.sum("support").alias("s")).select(
        F.lit("accuracy").alias("class"), F.col("a").alias("precision"), F.col("a").alias("recall"),
        F.col("a").alias("f1"), F.col("s").cast("long").alias("support"))
    return per.unionByName(weighted).unionByName(acc)


def metric_set(df: DataFrame, label: str = "label", score: str = "prob", threshold: float = 0.5) -> DataFrame:
    """One row for a scored set: accuracy, support-weighted precision, recall and F1 at the threshold, ROC AUC,
    log-loss, n_pos, n_neg. Rows are scored once: all of it is taken from the written counts by label and score."""
    y = F.col(label).cast("int")
    rated = df.groupBy(y.alias("label"), F.col(score).alias("prob")).agg(F.count(F.lit(1)).alias("n"))
    rated = saved(rated).where("label is not null and prob is not null").withColumn("pred", (F.col("prob") >= threshold).cast("int"))
    by_class = class_metrics(rated, weight="n")
    pick = lambda cls, c: F.max(F.when(F.col("class") == cls, F.col(c)))
    row = by_class.agg(pick("accuracy", "recall").alias("accuracy"), *[pick("weighted", c).alias(c) for c in ("precision", "recall", "f1")])
    row = attach(row, roc_auc(rated, weight="n"))
    return attach(row, log_loss(rated, weight="n").select("log_loss")).select("accuracy", "precision", "recall", "f1", "auc", "log_loss", "n_pos", "n_neg")


def roc_auc_ovr(df: DataFrame, label: str, scores: Mapping[str, str]) -> DataFrame:
    """One-vs-rest AUC of every class (class → score column) with its support, and their mean ('macro') and
    support-weighted mean ('weighted'). Rows are stacked by class and ranked in one grouped pass."""
    entries = F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("prob")) for k, c in scores.items()])
    long = df.select(F.col(label).alias("__y"), F.explode(entries).alias("__s")).select(
        "__s.class", "__s.prob", (F.col("__y") == F.col("__s.class")).cast("int").alias("label")
    )
    per = roc_auc(long, by=["class"]).select("class", "auc", F.col("n_pos").alias("support"))
    means = per.agg(
        F.avg("auc").alias("m"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("w"), F.sum("support").alias("s")
    )
    rows = means.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(v).alias("auc"), F.col("s").alias("support")) for k, v in (("macro", "m"), ("weighted", "w"))
    ])))
    return per.unionByName(rows)


def log_loss(df: DataFrame, label: str = "label", score: str = "prob", eps: float = 1e-15, weight: str | None = None) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    if weight:
        n = F.sum(F.when(loss.isNotNull(), F.col(weight)))
        return df.agg((F.sum(loss * F.col(weight)) / n).alias("log_loss"), F.sum(F.when(y.isNotNull(), F.col(weight))).alias("n"))
    return df.agg(F.avg(loss).alias("log_loss"), F.count(y).alias("n"))


def brier(df: DataFrame, label: str = "label", score: str = "prob") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"), F.count(F.col(label)).alias("n"))


def calibration_curve(df: DataFrame, label: str = "label", score: str = "prob", n_bins: int = 10) -> DataFrame:
    """Quantile bins (edges = exact quantiles of the score); bin id = number of inner edges below the score;
    per non-empty bin: mean predicted, observed share, n."""
    inner = [i / n_bins for i in range(1, n_bins)]
    from wavekit.operators.profile import quantiles

    # as many values as there are inner edges
    edges = quantiles(df, score, inner).agg(F.array_sort(F.collect_list("value")).alias("__e"))
    binned = attach(df, edges).withColumn(
        "bin", F.size(F.filter(F.col("__e"), lambda e: e < F.col(score))).cast("int")
    )
    return binned.groupBy("bin").agg(
        F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed_share"),
        F.count(F.lit(1)).alias("n"),
    )


def degradation(df: DataFrame, expected: str, observed: str) -> DataFrame:
    """Expected − observed score, also in % of expected, with the verbal band of the absolute drop."""
    d = F.col(expected) - F.col(observed)
    band = F.lit(BANDS[-1][1])
    for limit, name in reversed(BANDS[:-1]):
        band = F.when(d < limit, name).otherwise(band)
    return df.withColumns({"degradation": d, "degradation_pct": 100 * d / F.col(expected), "band": band})
