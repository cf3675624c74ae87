"""A corpus pipeline: quality, near duplicates, benchmark contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame; run() applies them to documents. Every stage but the last returns the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm import decontaminate, ngram_join, packing, quality, secrets
from cytoframe.llm._session import shared_dir, spread, table
from cytoframe.llm.queries import tokenizer_json

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENTS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier predicts to be of class 1."""
    docs = _only(docs)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _only(quality.score_quality(docs, model).where("quality_predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, 0.8): the least doc_id and, among its rows, the least hash of the text.

    Rows alike in id and text are one document, with or without words. Texts without words are in no group.
    """
    groups = ngram_join.similar_documents(_only(docs), ngram_join.SHINGLE, ngram_join.PERCENT)
    # A null id takes two plain columns, so that one shuffle serves the join and the search for repeated rows.
    key = {"_id": F.coalesce("doc_id", F.lit(0)), "_null": F.col("doc_id").isNull()}
    kept = groups.where("kept").withColumns(key).select(*key, "text_hash").distinct()
    rows = _only(docs).withColumns({**key, "text_hash": F.xxhash64("text")})
    return _only(rows.join(kept, [*key, "text_hash"], "left_semi").dropDuplicates([*key, "text_hash"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates; rows are judged by their texts, not their ids."""
    judged = decontaminate.contamination(_only(docs), table(spark, sf_dir, "benchmark"))
    found = judged.where("contaminated").select(F.col("doc_id").alias("_found"), "_text").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_found")) & (F.xxhash64("text") == F.col("_text"))
    return _only(docs.join(found, same, "left_anti"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in every text; no document goes."""
    return _only(secrets.mask_secrets(_only(docs)).withColumn("n_chars", F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of token ids."""
    return packing.pack_tokens(_only(docs), tokenizer_json(), chunked=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither a fitted model nor its training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and reread as the next one's docs."""
    docs, folder = spread(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
