"""Session helpers: building a session for tests/bench and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "wavekit") -> SparkSession:
    """Local session used by tests, tools and bench.py. On a cluster the caller passes its own session."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``. Only on one machine (a ``local`` master, as in tests) is an
    unset one replaced by a folder of our own; on a cluster that would be a folder other machines don't see, so it
    raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="wavekit-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: what is derived from it reads it instead of computing it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``saved``, as a parquet table under the checkpoint folder: for rows that several passes read a few columns of."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one partition of ``spread`` or ``packed`` rows, at most about.
PART_ROWS = 200_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``written`` rows in even partitions by the hash of ``key``: as many as there are cores where the rows suffice for
    more than a few, more as the rows grow, so that no learner's task holds a growing share of them."""
    rows = written(df)
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(cores, -(-n // 5_000)), -(-n // PART_ROWS)), key)


def packed(df: DataFrame) -> DataFrame:
    """``saved`` rows in no more partitions than ``PART_ROWS`` asks for: for many fits side by side whose stages are short,
    as what the tasks send to the driver grows with partitions × stages."""
    rows = saved(df)
    parts, have = max(1, -(-rows.count() // PART_ROWS)), rows.rdd.getNumPartitions()
    if have < parts:
        return saved(rows.repartition(parts))
    return saved(rows.coalesce(parts)) if have > parts else rows


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for tables written by a job (never machine-local)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/wavekit-{name}-{uuid.uuid4().hex[:12]}"
