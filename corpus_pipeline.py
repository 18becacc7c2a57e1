"""Corpus pipeline: quality filter, exact dedup, near-dedup, source mixing, tokenising.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), applies one operator of
``wavekit.llm`` to all rows of ``docs`` and returns what it keeps, with the columns of ``docs`` (the last one:
token ids). ``run`` applies them to ``documents``, writing every stage as Parquet in the shared folder.

Rows are told apart by (doc_id, text), as ids may be null or repeated; every stage keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavekit.llm.common import read_documents, whole_text, without_spaces
from wavekit.session import scratch_path

#: A trained classifier, iterative components, balanced sampling and tokenising have no SQL twin.
ORACLE_SQL = None


def _keep(docs: DataFrame, decisions: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, key) ``decisions(doc_id, key, kept)`` keeps; of rows that share both,
    one (the longest text) if any is kept."""
    of = decisions.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("k"))
    of = of.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "n", "k")
    match = F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__key"))
    kept = docs.join(of.where("n > 1 or k = 0").select("__id", "__key"), match, "left_anti")
    repeated = of.where("n > 1 and k > 0").select("__id", "__key")
    if repeated.isEmpty():
        return kept
    one = (
        docs.join(repeated, match)
        .groupBy("__id", "__key")
        .agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.length(whole_text("text")), F.col("text"))).alias("__row"))
    )
    return kept.unionByName(one.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.7) go."""
    from wavekit.llm.quality import quality_score, train_quality

    model = train_quality(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return docs.where(quality_score(model) >= 0.7)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    from wavekit.llm.exact import exact_dedup

    decisions = exact_dedup(docs).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return _keep(docs, decisions, F.sha2(without_spaces(whole_text("text")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates stays."""
    from wavekit.llm.common import cut
    from wavekit.llm.simhash import simhash_components

    found = cut(simhash_components(docs))
    # rows without an id stand for themselves beside the smallest id only where no other row has one
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), "text_key")).alias("best")
    best = cut(found.groupBy("component").agg(first))
    decisions = found.join(best, "component").select(
        "doc_id", F.col("text_key").alias("key"),
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key"))).alias("kept"),
    )
    return _keep(docs, decisions, F.xxhash64(whole_text("text")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times)."""
    from wavekit.llm.common import cut
    from wavekit.llm.mixing import mix_sources, numbered

    taken = cut(mix_sources(docs).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("nth").alias("__k"), F.col("copies").alias("__copies")))
    same_id = F.col("doc_id").eqNullSafe(F.col("__id"))
    if taken.groupBy("__id").count().where("count > 1").isEmpty():
        rows, match = docs, same_id
    else:  # repeated ids: the same numbering of equal rows as the operator's
        rows = numbered(docs)
        match = same_id & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__n_words") == F.col("__size")) & (F.col("__nth") == F.col("__k"))
    out = rows.join(taken.where("__copies > 0"), match)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    from wavekit.llm.pieces import MODEL_FILE, PieceTable, encode_pieces

    table = PieceTable.from_model(MODEL_FILE)
    coded = encode_pieces(docs.select("doc_id", "source", "lang", whole_text("text").alias("text")), table, decoded_col="decoded")
    return coded.select("doc_id", "source", "lang", "ids", F.size("ids").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", mixing),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    folder = scratch_path(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
