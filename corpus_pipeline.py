"""A training corpus out of the documents table: filter, clean, remove near-duplicates, take out secrets, pack.

Each stage is a function of (spark, docs, sf_dir). `run` writes each stage's rows as Parquet to the shared folder and reads
them again as the next stage's documents. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm import minhash, packing, quality, secrets, toxicity
from openchair.llm.common import Stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all thresholds."""
    return quality.keep_good(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of a model trained on the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), Stage(spark, "toxicity"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest id, null ids last; equal rows once.

    Where an id is null or stands for several texts, rows are compared under a key for each id and text.
    """
    stage = Stage(spark, "minhash")
    digest = F.sha2(docs["text"].cast("binary"), 256)
    texts = stage.write(docs.select(F.col("doc_id").alias("_id"), digest.alias("_digest")).distinct())
    n, n_ids = texts.agg(F.count("*"), F.count_distinct("_id")).first()
    if n == n_ids:
        found = minhash.near_duplicates(docs, stage)
        return docs.join(found.where("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    # Numbers in the order of the ids, written once so that they stay the same.
    keys = stage.write(texts.orderBy(F.col("_id").asc_nulls_last(), "_digest").withColumn("_key", F.monotonically_increasing_id()))
    same = docs["doc_id"].eqNullSafe(keys["_id"]) & digest.eqNullSafe(keys["_digest"])
    keyed = stage.write(docs.join(keys, same).dropDuplicates(["_key"]).select("_key", *docs.columns))
    found = minhash.near_duplicates(keyed, stage, id_col="_key")
    kept = found.where("kept").select(F.col("doc_id").alias("_key"))
    return keyed.join(kept, "_key", "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds, lengths counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, Stage(spark, "packing"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Toxicity is a trained model and packing an optimization, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir))
    return docs
