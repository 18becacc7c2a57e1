"""Queries for sources and sinks (§2.1) and the per-source harmonisation steps (§2.2): the survey view is
written as wave files (T3: one TSV per wave × form, outcome column named by period, one extra column in
one wave, form-specific sex/race/grade columns) under the shared checkpoint folder, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.operators import recode, setops
from wavekit.plans import fixtures as fx
from wavekit.plans.q_rank import WAVE_COEF_SQL, wave_race_coefs
from wavekit.plans.q_split import IMPUTED_COLS, stack
from wavekit.plans.registry import register
from wavekit.plans.views import with_views
from wavekit.session import scratch_path
from wavekit.sources import sinks, waves

STRING_COLS = ["V2151", "V1070"]
DOUBLE_COLS = ["ARCHIVE_WT"]
EXTRA_WAVE = 2000


def _columns(wave: int, form: str) -> list:
    k = F.col("respondent_id")
    cols = [
        k.alias("RESPONDENT_ID"),
        F.col("nicotine12").alias("Q1" if wave < fx.BREAK_YEAR else "Q2"),
        F.col("sex_raw").alias("V2150" if form == "0012" else "V7202"),
        F.col("race").alias("V2151" if form == "0012" else "V1070"),
        F.col("region").alias("V13"),
    ]
    if form == "0810":
        cols.append((8 + 2 * (k % 2)).cast("int").alias("V501"))
    cols += [F.col("marijuana12"), F.col("alcohol12"), F.col("cigarette12"), F.col("survey_weight").alias("ARCHIVE_WT")]
    if wave == EXTRA_WAVE:
        cols.append((F.col("alcohol12") * 2).cast("int").alias("EXTRA_Q"))
    return cols


def wave_files(spark, d) -> list[waves.Source]:
    """One file per (wave, form) that the data has."""
    return write_waves(fx.survey_raw(spark, d), scratch_path(spark, "waves"))


def write_waves(raw: DataFrame, root: str) -> list[waves.Source]:
    keys = sorted((r.wave, r.form) for r in raw.select("wave", "form").distinct().collect())  # one row a file
    return waves.write_wave_files(raw, root, "wave", "form", {key: _columns(*key) for key in keys})


def _frames(spark, d):
    frames, report = waves.scan_tsv_waves(spark, wave_files(spark, d), STRING_COLS, DOUBLE_COLS)
    return frames, report


RAW_SQL = f"""SELECT 'wave_' || CAST(wave AS VARCHAR) || '_' || form AS source, respondent_id AS RESPONDENT_ID,
       CASE WHEN wave < {fx.BREAK_YEAR} THEN nicotine12 END AS Q1, CASE WHEN wave >= {fx.BREAK_YEAR} THEN nicotine12 END AS Q2,
       CASE WHEN form = '0012' THEN sex_raw END AS V2150, CASE WHEN form = '0810' THEN sex_raw END AS V7202,
       CASE WHEN form = '0012' THEN race END AS V2151, CASE WHEN form = '0810' THEN race END AS V1070,
       region AS V13, CASE WHEN form = '0810' THEN CAST(8 + 2 * (respondent_id % 2) AS INT) END AS V501,
       marijuana12, alcohol12, cigarette12, survey_weight AS ARCHIVE_WT,
       CASE WHEN wave = {EXTRA_WAVE} THEN CAST(alcohol12 * 2 AS INT) END AS EXTRA_Q, wave, form
FROM survey"""


def _with_source(frames) -> list[DataFrame]:
    return [df.withColumn("source", F.lit(name)) for name, df in frames.items()]


@register(
    "scan_tsv_waves",
    with_views(f"SELECT * EXCLUDE (wave, form) FROM ({RAW_SQL})", "survey"),
)
def q_scan_tsv_waves(spark, d):
    frames, _ = _frames(spark, d)
    return setops.union_fill(_with_source(frames))


def _harmonized(spark, d):
    frames, _ = _frames(spark, d)
    by_source = {name: ("Q1" if waves.source_name_parts(name)[0] < fx.BREAK_YEAR else "Q2") for name in frames}
    return _with_source(recode.harmonize_outcome(frames, by_source, "nicotine12"))


@register(
    "harmonize_outcome",
    with_views(
        f"""SELECT source, RESPONDENT_ID, coalesce(Q1, Q2) AS nicotine12, V13, marijuana12, alcohol12, cigarette12, ARCHIVE_WT
FROM ({RAW_SQL})""",
        "survey",
    ),
)
def q_harmonize_outcome(spark, d):
    return setops.union_common(_harmonized(spark, d))


def _recoded(spark, d):
    df = setops.union_fill(_harmonized(spark, d))
    df = recode.add_wave(df, "source", "wave")
    df = df.withColumn("form", F.regexp_extract("source", r"_(\d{4})$", 1))
    df = recode.add_grade(df, "form", "V501", 12, "0810", "grade")
    df = recode.add_race(df, {"0012": "V2151", "0810": "V1070"}, "form", "race")
    df = df.withColumn("sex_code", F.coalesce("V2150", "V7202"))
    return recode.recode_map(df, "sex_code", {1: 0, 2: 1}, "sex")


@register(
    "add_wave",
    with_views(f"SELECT source, RESPONDENT_ID, wave FROM ({RAW_SQL})", "survey"),
)
def q_add_wave(spark, d):
    return _recoded(spark, d).select("source", "RESPONDENT_ID", "wave")


@register(
    "add_grade",
    with_views(
        f"SELECT RESPONDENT_ID, form, CAST(CASE WHEN form = '0810' THEN V501 ELSE 12 END AS INT) AS grade FROM ({RAW_SQL})",
        "survey",
    ),
)
def q_add_grade(spark, d):
    return _recoded(spark, d).select("RESPONDENT_ID", "form", "grade")


@register(
    "add_race",
    with_views(
        f"""SELECT RESPONDENT_ID, CASE WHEN form = '0012' THEN V2151 WHEN form = '0810' THEN V1070 END AS race,
       CAST(CASE coalesce(V2150, V7202) WHEN 1 THEN 0 WHEN 2 THEN 1 END AS INT) AS sex
FROM ({RAW_SQL})""",
        "survey",
    ),
)
def q_add_race(spark, d):
    return _recoded(spark, d).select("RESPONDENT_ID", "race", "sex")


@register(
    "scan_discover",
    with_views(
        f"""SELECT source, wave, form, RESPONDENT_ID, V501, EXTRA_Q FROM ({RAW_SQL})
WHERE form = '0810' OR source = 'wave_2001_0012'""",
        "survey",
    ),
)
def q_scan_discover(spark, d):
    srcs = wave_files(spark, d)
    root = srcs[0].path.rsplit("/", 1)[0]
    extra = [s.path for s in srcs if s.name == "wave_2001_0012"]
    df = waves.scan_discover(spark, root, "0810.tsv", extra, STRING_COLS, DOUBLE_COLS)
    return df.select("source", "wave", "form", "RESPONDENT_ID", "V501", "EXTRA_Q")


CLEAN_COLS = "respondent_id, wave, sex, race, region, marijuana12, alcohol12, cigarette12, survey_weight, y"


@register("scan_csv", with_views(f"SELECT {CLEAN_COLS} FROM survey_clean", "survey_clean"))
def q_scan_csv(spark, d):
    clean = fx.survey_clean(spark, d)
    path = sinks.sink_table(clean, scratch_path(spark, "clean-csv"), fmt="csv")
    return waves.scan_csv(spark, path, schema=clean.schema)


@register("sink_table", with_views(f"SELECT {CLEAN_COLS} FROM survey_clean", "survey_clean"))
def q_sink_table(spark, d):
    clean = fx.survey_clean(spark, d)
    path = sinks.sink_table(clean, scratch_path(spark, "clean"))
    return spark.read.parquet(path)


def _family(spark, d):
    return sinks.sink_imputations(stack(spark, d), scratch_path(spark, "imputed"))


@register("sink_imputations", with_views(f"SELECT {IMPUTED_COLS} FROM imputed", "imputed"))
def q_sink_imputations(spark, d):
    return spark.read.parquet(_family(spark, d)).select(*[c.strip() for c in IMPUTED_COLS.split(",")])


@register(
    "scan_imputed_family",
    with_views("SELECT imp, count(*) AS n, sum(y) AS sum_y FROM imputed GROUP BY imp", "imputed"),
)
def q_scan_imputed_family(spark, d):
    fam = sinks.scan_imputed_family(spark, _family(spark, d), m=fx.N_IMPUTATIONS, require_all=True)
    return fam.groupBy("imp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"))


@register(
    "scan_results_glob",
    with_views(f"WITH {WAVE_COEF_SQL}\nSELECT model, variable, beta, se FROM wc0", "survey_clean"),
)
def q_scan_results_glob(spark, d):
    coefs = wave_race_coefs(spark, d).select("model", "variable", "beta", "se").persist()
    names = [r[0] for r in coefs.select("model").distinct().collect()]
    root = scratch_path(spark, "results")
    sinks.sink_results({n: coefs.where(F.col("model") == n).drop("model") for n in names}, root)
    coefs.unpersist()
    return sinks.scan_results_glob(spark, root, "variable string, beta double, se double")
