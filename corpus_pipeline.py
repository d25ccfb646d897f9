"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import dedup, language, mixing, pieces, similar, simhash
from reelframe.llm.queries import vocabulary_path
from reelframe.llm.work import delete, fresh, scratch, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter) go."""
    return language.keep_identified(docs, language.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity >= 0.8) the document with the smallest id stays."""
    return simhash.drop_near_copies(docs, groups=similar.near_copies)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those it doesn't take go."""
    kid, khash, copies, dhash, one = fresh(docs, "m_id", "m_hash", "m_copies", "d_hash", "m_one")
    taken = mixing.mix(docs).where("copies > 0").groupBy("doc_id", "text_hash").agg(F.max("copies").alias(copies))
    # Repeated rows share their number of copies; each of them is a row of docs.
    taken = table(taken.toDF(kid, khash, copies), "pipeline_copies")
    marked = docs.withColumn(dhash, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = marked.join(taken, F.col("doc_id").eqNullSafe(F.col(kid)) & (F.col(dhash) == F.col(khash)))
    return joined.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, their number, and the digests of ids and decoded text."""
    return pieces.encode_decode(docs, vocabulary_path()).drop("decoded")


STAGES = [("language", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]

#: The mix hashes random odds, the language model is trained: SQL can't express the rows; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's scratch tables and its input go once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/reelframe/pipeline-{uuid.uuid4().hex}"
    done = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}_{name}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if done:
            delete(spark, done)
        done = path
    return docs
