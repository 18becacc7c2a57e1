"""Queries for discrimination / calibration metrics (§2.9) on the scored-rows view, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavekit.functions.scalars import attach
from wavekit.operators import evaluate, inference
from wavekit.plans import fixtures as fx
from wavekit.plans.newton_sql import two_sided_p_sql
from wavekit.plans.registry import register
from wavekit.plans.views import with_views


def _sc(spark, d):
    return fx.scored(spark, d)


AUC_SQL = """SELECT sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT score, pos, neg,
             coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
      FROM (SELECT {score} AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
            FROM scored {where} GROUP BY {score}))"""


@register("roc_auc", with_views(AUC_SQL.format(score="prob", where=""), "scored"))
def q_roc_auc(spark, d):
    return evaluate.roc_auc(_sc(spark, d), "label", "prob")


@register("roc_auc_ties", with_views(AUC_SQL.format(score="prob2", where=""), "scored"))
def q_roc_auc_ties(spark, d):
    return evaluate.roc_auc(_sc(spark, d), "label", "prob2")


@register(
    "roc_curve",
    with_views(
        """SELECT score AS threshold,
       (sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / sum(neg) OVER () AS fpr,
       (sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / sum(pos) OVER () AS tpr
FROM (SELECT prob AS score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
      FROM scored GROUP BY prob)""",
        "scored",
    ),
)
def q_roc_curve(spark, d):
    return evaluate.roc_curve(_sc(spark, d), "label", "prob")


@register(
    "confusion_matrix",
    with_views(
        """SELECT label, pred, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY label) AS row_share
FROM scored GROUP BY label, pred""",
        "scored",
    ),
)
def q_confusion_matrix(spark, d):
    return evaluate.confusion_matrix(_sc(spark, d), "label", "pred", normalize=True)


def _pred3(df):
    return df.withColumn(
        "pred3", F.when(F.col("prob") < 0.25, "O").when(F.col("prob") < 0.45, "F").otherwise("P")
    )


@register(
    "class_metrics",
    with_views(
        """WITH s AS (SELECT label3 AS t, CASE WHEN prob < 0.25 THEN 'O' WHEN prob < 0.45 THEN 'F' ELSE 'P' END AS p FROM scored),
cls AS (SELECT t AS c FROM s UNION SELECT p FROM s),
per AS (SELECT c AS class,
               sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS support,
               sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS predicted
        FROM cls, s GROUP BY c),
m AS (SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM per),
f AS (SELECT class, precision, recall,
             CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM m)
SELECT * FROM f
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', sum(recall * support) / sum(support), sum(recall * support) / sum(support),
                 sum(recall * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""",
        "scored",
    ),
)
def q_class_metrics(spark, d):
    return evaluate.class_metrics(_pred3(_sc(spark, d)), "label3", "pred3")


OVR = {"F": "prob", "O": "score_o", "P": "score_p"}


def _ovr_sql():
    parts = []
    for cls, score in (("F", "prob"), ("O", "1 - prob"), ("P", "1 - abs(prob - 0.5)")):
        parts.append(
            f"""SELECT '{cls}' AS class, sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS auc, CAST(sum(pos) AS BIGINT) AS support
FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {score} AS s, sum(CASE WHEN label3 = '{cls}' THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN label3 = '{cls}' THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY 1))"""
        )
    return with_views(
        "WITH per AS (" + "\nUNION ALL ".join(parts) + """)
SELECT * FROM per UNION ALL SELECT 'macro', avg(auc), CAST(sum(support) AS BIGINT) FROM per
UNION ALL SELECT 'weighted', sum(auc * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per""",
        "scored",
    )


@register("roc_auc_ovr", _ovr_sql())
def q_roc_auc_ovr(spark, d):
    s = _sc(spark, d).withColumns({"score_o": 1 - F.col("prob"), "score_p": 1 - F.abs(F.col("prob") - 0.5)})
    return evaluate.roc_auc_ovr(s, "label3", OVR)


@register(
    "metric_set",
    with_views(
        f"""WITH s AS (SELECT label AS t, pred AS p FROM scored),
per AS (SELECT c, sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t = c THEN 1 ELSE 0 END) AS support,
               sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS predicted FROM (SELECT unnest([0, 1]) AS c), s GROUP BY c),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM per),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m),
a AS ({AUC_SQL.format(score="prob", where="")})
SELECT sum(tp) / sum(support) AS accuracy, sum(pr * support) / sum(support) AS precision, sum(re * support) / sum(support) AS recall,
       sum(f1 * support) / sum(support) AS f1, any_value(a.auc) AS auc,
       (SELECT -avg(label * ln(prob) + (1 - label) * ln(1 - prob)) FROM scored) AS log_loss,
       any_value(a.n_pos) AS n_pos, any_value(a.n_neg) AS n_neg FROM f, a""",
        "scored",
    ),
)
def q_metric_set(spark, d):
    return evaluate.metric_set(_sc(spark, d))


@register(
    "log_loss",
    with_views(
        """SELECT -avg(label * ln(least(greatest(prob, 1e-15), 1 - 1e-15))
               + (1 - label) * ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15))) AS log_loss, count(label) AS n FROM scored""",
        "scored",
    ),
)
def q_log_loss(spark, d):
    return evaluate.log_loss(_sc(spark, d))


@register("brier", with_views("SELECT avg(pow(prob - label, 2)) AS brier, count(label) AS n FROM scored", "scored"))
def q_brier(spark, d):
    return evaluate.brier(_sc(spark, d))


@register(
    "calibration_curve",
    with_views(
        """WITH e AS (SELECT quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored)
SELECT CAST(len(list_filter(edges, lambda x: x < prob)) AS INT) AS bin, avg(prob) AS mean_predicted,
       avg(CAST(label AS DOUBLE)) AS observed_share, count(*) AS n
FROM scored, e GROUP BY ALL""",
        "scored",
    ),
)
def q_calibration_curve(spark, d):
    return evaluate.calibration_curve(_sc(spark, d))


@register(
    "auc_difference_z",
    with_views(
        f"""WITH a AS ({AUC_SQL.format(score="prob", where="")}), b AS ({AUC_SQL.format(score="prob2", where="")}),
j AS (SELECT a.auc AS auc_1, a.n_pos + a.n_neg AS n, b.auc AS auc_2 FROM a, b),
k AS (SELECT *, auc_1 - auc_2 AS auc_diff, sqrt((auc_1 * (1 - auc_1) + auc_2 * (1 - auc_2)) / n) AS se FROM j)
SELECT *, auc_diff / se AS z, {two_sided_p_sql('auc_diff / se')} AS p_value FROM k""",
        "scored",
    ),
)
def q_auc_difference_z(spark, d):
    s = _sc(spark, d)
    return inference.auc_difference_z(evaluate.roc_auc(s, "label", "prob"), evaluate.roc_auc(s, "label", "prob2"))


@register(
    "degradation",
    with_views(
        f"""WITH e AS ({AUC_SQL.format(score="prob", where="WHERE year <= 1995")}),
o AS ({AUC_SQL.format(score="prob", where="WHERE year > 1995")})
SELECT e.auc AS expected_auc, o.auc AS observed_auc, e.auc - o.auc AS degradation,
       100 * (e.auc - o.auc) / e.auc AS degradation_pct,
       CASE WHEN e.auc - o.auc < 0.03 THEN 'Excellent' WHEN e.auc - o.auc < 0.05 THEN 'Good'
            WHEN e.auc - o.auc < 0.10 THEN 'Moderate' ELSE 'Significant' END AS band
FROM e, o""",
        "scored",
    ),
)
def q_degradation(spark, d):
    s = _sc(spark, d)
    e = evaluate.roc_auc(s.where(F.col("year") <= 1995)).select(F.col("auc").alias("expected_auc"))
    o = evaluate.roc_auc(s.where(F.col("year") > 1995)).select(F.col("auc").alias("observed_auc"))
    return evaluate.degradation(attach(e, o), "expected_auc", "observed_auc")
