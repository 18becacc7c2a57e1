"""Helpers shared by the operators: text expressions, checkpoints, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekit.session import ensure_checkpoint_dir

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(text_col: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def without_spaces(text: Column) -> Column:
    """Delete every white-space character (byte-level replace, no regular expression)."""
    for ch in SPACES:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """At least the session's shuffle partitions, and no more than ``per_partition`` rows in each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def hash_sample(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """At most about 1.5 times ``rows`` of ``total`` rows, those with the smallest hashes: a filter, so that a
    following ``limit`` does not gather rows from every partition."""
    share = min(1.0, 1.5 * rows / max(total, 1) + 20 / max(total, 1))
    return df.where(F.pmod(key, F.lit(1 << 40)) <= int(share * (1 << 40)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge.

    ``edges`` has two columns of one ordered type (self links and repeats allowed). Alternating large-star and
    small-star rounds: every round keeps connectivity, replaces links by links to smaller nodes and ends with
    one star per component; rounds grow with the logarithm of a component's diameter. A node's smallest
    neighbour is a partially aggregated minimum joined back, so a hub is split by the skew-join rule and no
    component is ever collected. Lineage is cut every round.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link now points from a larger to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
