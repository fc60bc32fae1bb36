"""The corpus pipeline: quality, line dedup, near-duplicate documents, mixing and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.llm.common import scratch_path, table
from barspan.llm.line_dedup import line_dedup
from barspan.llm.mixing import mix
from barspan.llm.ngram_join import ngram_join
from barspan.llm.packing import best_fit_packing
from barspan.llm.pu_quality import quality_scores
from barspan.llm.queries import vocabulary


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands a thousand rows at a time to Python: ten thousand texts, the default, take tens of
    megabytes in each worker and again in its executor. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(1000, now) if now > 0 else 1000))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.7 or more). Null texts are scored as empty; repeated rows stay together."""
    small_batches(spark)
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), columns=tuple(docs.columns))
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that other documents keep."""
    small_batches(spark)
    return line_dedup(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates; rows without doc_id or words stay."""
    small_batches(spark)
    others = ngram_join(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others.hint("shuffle_hash"), docs["doc_id"] == others["doc_id"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow tempered shares of sources, languages and topics."""
    small_batches(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in packed sequences: ids, lengths and checksums, no texts.

    Every row that mixing kept is packed, also one without text or doc_id; an empty table gives no pieces.
    """
    small_batches(spark)
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The classifier's training has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result goes to the shared folder and is read from there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
