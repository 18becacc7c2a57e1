"""Sinks and result-file scans: tables, the imputed family, per-model result files, the model registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite",
               header: bool = True) -> str:
    """Write a stage table (parquet by default; csv with header). Returns the path."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def sink_imputations(stack: DataFrame, root: str, imp_col: str = "imp") -> str:
    """The long stack of M completed sets, one directory per set (``imp=<i>``)."""
    stack.write.mode("overwrite").partitionBy(imp_col).parquet(root)
    return root


def scan_imputed_family(spark: SparkSession, root: str, m: int | None = None, require_all: bool = False,
                        imp_col: str = "imp") -> DataFrame:
    """One read of all sets (``imp`` from the directory names). Requires ≥ 1 set, or exactly ``m`` with
    ``require_all``; the check is a distinct count over the partition column (metadata-sized)."""
    df = spark.read.parquet(root)
    found = df.select(imp_col).distinct().count()
    if found < 1:
        raise ValueError(f"no imputed sets under {root}")
    if require_all and m is not None and found != m:
        raise ValueError(f"expected {m} imputed sets under {root}, found {found}")
    return df


def sink_results(tables: Mapping[str, DataFrame], root: str, pattern: str = "Model_{name}_results.csv") -> list[str]:
    """Write one CSV result file (directory) per model name."""
    out = []
    for name, df in tables.items():
        path = f"{root.rstrip('/')}/{pattern.format(name=name)}"
        df.write.mode("overwrite").option("header", True).csv(path)
        out.append(path)
    return out


def scan_results_glob(spark: SparkSession, root: str, schema, glob: str = "Model_*_results.csv",
                      name_regex: str = r"Model_(.+?)_results\.csv") -> DataFrame:
    """Gather every per-model result file in one scan; the model name comes from the file path."""
    df = spark.read.option("header", True).schema(schema).csv(f"{root.rstrip('/')}/{glob}")
    return df.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), name_regex, 1))


class ModelRegistry:
    """Spark ML models saved and loaded by name under one root (``<root>/<name>``)."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, model) -> str:
        model.write().overwrite().save(self.path(name))
        return self.path(name)

    def exists(self, name: str, spark: SparkSession | None = None) -> bool:
        spark = spark or SparkSession.getActiveSession()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def load(self, name: str, loader, fallbacks: Sequence[str] = ()):
        """Load the first of name and fallbacks that was saved; raises if none was, and if the saved one can't be read."""
        for n in [name, *fallbacks]:
            if self.exists(n):
                return loader.load(self.path(n))
        raise FileNotFoundError(f"no model saved as {[name, *fallbacks]} under {self.root}")

    def load_many(self, names: Mapping[str, object], minimum: int = 3) -> dict:
        """Load every model that was saved ({name: loader}), at least ``minimum``; a saved model that can't be read
        raises."""
        got = {n: loader.load(self.path(n)) for n, loader in names.items() if self.exists(n)}
        if len(got) < minimum:
            raise ValueError(f"only {len(got)} models found, {minimum} required")
        return got


def snapshot_features(df: DataFrame, pipeline_model, feature_lists: Mapping[str, Sequence[str]], root: str) -> str:
    """Persist split data (with its ``split`` column), the fitted preprocessor and the feature lists together."""
    spark = df.sparkSession
    root = root.rstrip("/")
    df.write.mode("overwrite").parquet(f"{root}/data")
    pipeline_model.write().overwrite().save(f"{root}/preprocessor")
    rows = [(k, i, f) for k, fs in feature_lists.items() for i, f in enumerate(fs)]
    spark.createDataFrame(rows, "list string, position int, feature string").write.mode("overwrite").parquet(f"{root}/features")
    return root


def load_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, object, dict[str, list[str]]]:
    """(data, fitted preprocessor, feature lists) as ``snapshot_features`` wrote them."""
    from pyspark.ml import PipelineModel

    root = root.rstrip("/")
    lists: dict[str, list[str]] = {}
    for r in spark.read.parquet(f"{root}/features").orderBy("list", "position").collect():  # the feature lists
        lists.setdefault(r["list"], []).append(r["feature"])
    return spark.read.parquet(f"{root}/data"), PipelineModel.load(f"{root}/preprocessor"), lists
