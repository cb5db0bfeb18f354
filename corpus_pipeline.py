"""A training-data pipeline over ``documents``: five stages, each of them one operator of lumenframe.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from lumenframe.llm.common import BROADCAST_IDS, Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The number of a row: decisions find their row by it, as ids may repeat or be null. The first stage gives it, the next ones keep it.
ROW = "row"
#: The stage of language ID rejects documents of which no language gets this share of the classifier's score.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with numbers of rows; tables that have none are written with them, so each read gives the same ones."""
    if ROW in docs.columns:
        return docs.select(ROW, *COLUMNS)
    return Workspace(docs.sparkSession, "rows").save(docs.select(F.monotonically_increasing_id().alias(ROW), *COLUMNS))


def _with(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with the columns of rows (numbers of rows and decisions), for the numbers that rows has.

    rows are written first, so they are counted; they are broadcast only when few.
    """
    rows = Workspace(docs.sparkSession, "stage").save(rows)
    n = rows.count()
    return docs.join(F.broadcast(rows) if n <= BROADCAST_IDS else rows, ROW)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters of which a language gets at least LEAST_SCORE. Learns from all labelled documents.

    Where these teach nothing, all documents with letters stay.
    """
    model = language_id.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(F.monotonically_increasing_id().alias(ROW), *COLUMNS)
    predicted = language_id.predict_with(model, docs, ["text", "lang", "source", "n_chars"])
    return predicted.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select(F.monotonically_increasing_id().alias(ROW), *COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: that of the largest id; of several such rows, or of null ids only, the least by a hash of the row."""
    docs = _numbered(docs)
    found = exact_dedup.exact_dedup(docs.withColumn("tie", F.xxhash64(*COLUMNS)), extra=["tie", ROW]).where("kept")
    kept = found.groupBy("text_sha256").agg(F.min(F.struct("tie", ROW)).alias("x")).select(f"x.{ROW}")
    return _with(docs, kept).repartition(F.col(ROW))  # even parts: the next stage's memory follows the size of a part


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8).

    It is that of the least id, null after all others; of several such rows, the least by a hash of the row.
    """
    docs = _numbered(docs)
    found = ngram_join.jaccard_components(docs, k=5, num=80, den=100, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    order = docs.select(ROW, F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*COLUMNS).alias("tie"))
    least = found.join(order, ROW).groupBy("component_id").agg(F.min(F.struct("no_id", "id", "tie", ROW)).alias("x"))
    return _with(docs, least.select(f"x.{ROW}"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it: not at all, once or more."""
    docs = _numbered(docs)
    taken = mixing.mix(docs.withColumn("tie", F.xxhash64(*COLUMNS)), extra=["tie", ROW]).where("copies > 0").select(ROW, F.col("copies").cast("int").alias("copies"))
    return _with(docs, taken).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(ROW, *COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, checked by decoding them."""
    return sentencepiece_codec.encode_decode(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Kernel scores and tokenizer ids are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again as the next one's input."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
