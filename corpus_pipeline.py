"""From documents to training sequences: five stages, each one of the operators of prepline.llm.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but
the last return the columns of ``documents``. Between stages the documents are written as
Parquet to the session's shared checkpoint folder and read again, so a lost executor never
sends the work back before the last finished stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepline.llm import line_dedup, minhash, mixing, packing, quality_classifier
from prepline.llm.common import cut, table
from prepline.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    judged = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles, by links:
    decided by id and text, so texts that share an id are told apart and of repeated rows one
    stays. A document without an id goes if its group has one with an id; documents without
    words belong to no group."""
    marks = minhash.near_duplicates(docs.select("doc_id", "text"), shingle=5, threshold=80, band=6)
    marks = cut(marks.where("n_shingles > 0").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"), F.min("kept").alias("kept"), F.min("component_id").alias("group")))
    here = F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"))

    def those(d: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        return d.join(some, F.col("_at.doc_id").eqNullSafe(F.col("_id")) & (F.col("_at.mark") == F.col("_mark")), how)

    left = those(docs.withColumn("_at", here), marks.where("not kept and group is not null"), "left_anti")
    again = cut(marks.where("rows > 1 and (kept or group is null)"))
    if not again.isEmpty():
        left = those(left, again, "left_anti").unionByName(those(left, again, "left_semi").dropDuplicates(["_at"]))
    return left.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole (0 to 3 times); a document that the end of
    its source's share cuts is left out."""
    served = mixing.mix(cut(mixing.sized(docs))).where("take = size and size > 0")
    times = served.groupBy("doc_id", "source", "size").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("bucket", "rn").alias("rows")
    )
    times = times.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.ceil(F.col("n") / F.col("rows")).cast("int").alias("_n")
    )
    d = docs.withColumn("_words", mixing.size_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    return d.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.sequences(docs.select("doc_id", "text"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("mixing", mixture), ("best_fit_packing", pack)]

#: models, near duplicates and tokens are beyond SQL; tests/llm checks the stages' columns, ids and
#: lengths, no test compares rows of run() with brute force yet
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return out
