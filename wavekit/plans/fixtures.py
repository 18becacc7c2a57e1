"""Survey-shaped views derived from the driver tables (see FIXTURES.md).

Every view is a lazy DataFrame over the parquet tables, so its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekit.sources.tables import table

# Fixed values of the fixture design (FIXTURES.md): sentinel codes and the structural break.
SENTINELS = (-9, -8)
BREAK_YEAR = 1998
KEY_VARS = ("marijuana12", "alcohol12", "cigarette12")
N_IMPUTATIONS = 5


def survey_raw(spark: SparkSession, data_dir: str) -> DataFrame:
    """T1: one row per respondent (order) with raw integer codes and −9/−8 sentinels."""
    o = table(spark, data_dir, "orders")
    c = table(spark, data_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, data_dir, "nation").select("n_nationkey", "n_regionkey")
    li = (
        table(spark, data_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.max("l_linenumber").alias("max_line"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"),
        )
    )
    k = F.col("o_orderkey")
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(li, k == F.col("l_orderkey"), "left")
    )
    return j.select(
        k.alias("respondent_id"),
        F.year("o_orderdate").cast("int").alias("wave"),
        F.when(k % 3 == 0, "0810").otherwise("0012").alias("form"),
        F.when(k % 29 == 0, -9)
        .when(k % 31 == 0, -8)
        .otherwise(F.substring("o_orderpriority", 1, 1).cast("int"))
        .cast("int")
        .alias("nicotine12"),
        F.when(k % 37 == 0, -9).otherwise(1 + F.col("o_custkey") % 2).cast("int").alias("sex_raw"),
        F.col("c_mktsegment").alias("race"),
        (F.col("n_regionkey") + 1).cast("int").alias("region"),
        F.when(k % 41 == 0, -9)
        .otherwise(F.least(F.coalesce("n_lines", F.lit(0)), F.lit(6)) + 1)
        .cast("int")
        .alias("marijuana12"),
        F.when(k % 43 == 0, -8).otherwise(F.coalesce("n_ret", F.lit(0)) % 7 + 1).cast("int").alias("alcohol12"),
        F.when(k % 47 == 0, -9).otherwise(F.coalesce("max_line", F.lit(0)) + 1).cast("int").alias("cigarette12"),
        F.when(k % 53 == 0, None).otherwise(F.col("o_totalprice") / 1000.0).cast("double").alias("survey_weight"),
    )


def survey_clean(spark: SparkSession, data_dir: str) -> DataFrame:
    """T2: sentinels to null, outcome dichotomised, sex recoded, complete on y/sex/race."""
    from wavekit.operators import recode

    raw = survey_raw(spark, data_dir)
    df = recode.sentinel_to_null(raw, SENTINELS)
    df = recode.dichotomize(df, "nicotine12", "y")
    df = recode.recode_map(df, "sex_raw", {1: 0, 2: 1}, "sex")
    df = recode.filter_complete(df, ["y", "sex", "race"])
    return df.select(
        "respondent_id", "wave", "sex", "race", "region", *KEY_VARS, "survey_weight", "y"
    )


def importances(spark: SparkSession, data_dir: str) -> DataFrame:
    """T5 at slot level: (model, feature, slot, importance).

    model m<k> collects lineitem rows with line number k; feature = part brand;
    slot = brand:type (the one-hot slot that the base feature expands into).
    """
    li = table(spark, data_dir, "lineitem").select("l_partkey", "l_linenumber", "l_extendedprice")
    p = table(spark, data_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (
        li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_linenumber", "p_brand", "p_type")
        .agg(F.sum("l_extendedprice").alias("importance"))
        .select(
            F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"),
            F.col("p_brand").alias("feature"),
            F.concat_ws(":", "p_brand", "p_type").alias("slot"),
            "importance",
        )
    )


def feature_importances(spark: SparkSession, data_dir: str) -> DataFrame:
    """T5 at feature level: (model, feature, importance)."""
    return (
        importances(spark, data_dir)
        .groupBy("model", "feature")
        .agg(F.sum("importance").alias("importance"))
    )


def scored(spark: SparkSession, data_dir: str) -> DataFrame:
    """T6: (row_id, label, prob, pred, prob2, label3, year) scored rows from orders."""
    o = table(spark, data_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    prob = F.least(F.greatest(F.col("o_totalprice") / 500000.0, F.lit(0.001)), F.lit(0.999)).cast("double")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        prob.alias("prob"),
        (prob >= 0.5).cast("int").alias("pred"),
        F.round(prob, 2).alias("prob2"),
        F.col("o_orderstatus").alias("label3"),
        F.year("o_orderdate").cast("int").alias("year"),
    )
