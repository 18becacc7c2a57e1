"""Wave files: one delimited file (Spark: one directory of parts) per (year, grade form).

Reading pins the schema per form from the header line only (no inference pass over the data):
integer codes unless a column is named as string or double.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_RE = r"wave_(\d{4})_(\d{4})\.tsv"


@dataclass(frozen=True)
class Source:
    name: str  # e.g. wave_1995_0012
    path: str


def header_columns(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Column names from the header line (no data pass)."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def pinned_schema(columns: Sequence[str], string_cols: Sequence[str] = (), double_cols: Sequence[str] = ()) -> T.StructType:
    s, d = set(string_cols), set(double_cols)
    return T.StructType(
        [
            T.StructField(c, T.StringType() if c in s else T.DoubleType() if c in d else T.LongType()
                          if c.upper().endswith("_ID") else T.IntegerType())
            for c in columns
        ]
    )


def scan_tsv_waves(
    spark: SparkSession,
    sources: Sequence[Source],
    string_cols: Sequence[str] = (),
    double_cols: Sequence[str] = (),
    sep: str = "\t",
    on_error: str = "raise",
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Read every source with its pinned schema. A source that cannot be opened raises; with ``on_error="skip"`` it is
    left out and the report says why.

    Returns ({name: DataFrame}, report DataFrame(source, status, n_columns, message)).
    """
    if on_error not in ("raise", "skip"):
        raise ValueError(on_error)
    frames: dict[str, DataFrame] = {}
    report = []
    for src in sources:
        try:
            cols = header_columns(spark, src.path, sep)
            schema = pinned_schema(cols, string_cols, double_cols)
            frames[src.name] = (
                spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").schema(schema).csv(src.path)
            )
            report.append((src.name, "ok", len(cols), ""))
        except Exception as e:
            if on_error == "raise":
                raise
            report.append((src.name, "skipped", 0, f"{type(e).__name__}: {str(e)[:200]}"))
    rep = spark.createDataFrame(report, "source string, status string, n_columns int, message string")
    return frames, rep


def scan_discover(spark: SparkSession, root: str, suffix: str = "0810.tsv", extra: Sequence[str] = (),
                  string_cols: Sequence[str] = (), double_cols: Sequence[str] = (), sep: str = "\t") -> DataFrame:
    """All files under ``root`` whose name ends with ``suffix`` (plus extra paths). The listing is a
    metadata-only glob; files are grouped by header layout and each layout is read in ONE scan (columns
    map by name, never by position); wave and form come from each row's ``_metadata.file_path``."""
    from functools import reduce

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*{suffix}")
    statuses = pattern.getFileSystem(conf).globStatus(pattern) or []
    paths = sorted(str(s.getPath().toString()) for s in statuses) + list(extra)
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        groups.setdefault(tuple(header_columns(spark, p, sep)), []).append(p)
    fp = F.col("_metadata.file_path")
    parts = []
    for cols, group in groups.items():
        schema = pinned_schema(cols, string_cols, double_cols)
        df = spark.read.option("header", True).option("sep", sep).schema(schema).csv(group)
        parts.append(
            df.withColumns(
                {
                    "source": F.regexp_extract(fp, r"(wave_\d{4}_\d{4})\.tsv", 1),
                    "wave": F.regexp_extract(fp, NAME_RE, 1).cast("int"),
                    "form": F.regexp_extract(fp, NAME_RE, 2),
                }
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Processed CSV with a header; a missing path is an error (FileNotFoundError)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(path)
    r = spark.read.option("header", True).option("sep", sep)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def source_name_parts(name: str) -> tuple[int, str]:
    m = re.search(r"(\d{4})_(\d{4})", name)
    if not m:
        raise ValueError(name)
    return int(m.group(1)), m.group(2)


def write_wave_files(df: DataFrame, root: str, wave_col: str, form_col: str, columns_by_source: Mapping[tuple[int, str], list],
                     sep: str = "\t") -> list[Source]:
    """Write one delimited file per (wave, form) with that source's own column list (names/exprs)."""
    out = []
    base = df.persist()
    try:
        for (wave, form), cols in sorted(columns_by_source.items()):
            name = f"wave_{wave}_{form}"
            path = f"{root.rstrip('/')}/{name}.tsv"
            part = base.where((F.col(wave_col) == wave) & (F.col(form_col) == form)).select(*cols)
            part.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
            out.append(Source(name, path))
    finally:
        base.unpersist()
    return out
