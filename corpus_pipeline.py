"""The corpus job: rank, deduplicate, redact, mix, encode.

Each stage reads what its predecessor wrote. All but the last return the columns of
documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.llm import mixing, neardup, pieces, quality, secrets
from touchstone.llm.common import table
from touchstone.llm.queries import vocabulary
from touchstone.session import cut, new_path

#: No SQL can express the learned, sketched and scanned stages.
ORACLE_SQL = None


def rank(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose Bradley-Terry score is below the cut; empty texts are judged like others."""
    ranking = quality.train(docs, table(spark, sf_dir, "labels"))
    name = "_quality"
    return quality.score(docs, ranking, name).where(F.col(name) >= quality.CUT).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five words, similarity 0.8.

    Rows that repeat the kept id are copies as well; one of them stays. Rows without an id
    and without a kept equal stay too, one per text.
    """
    groups = neardup.near_duplicates(docs, words=5, num=80, den=100)
    kept = groups.where("kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    counts = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    counts = cut(counts, "repeated")
    once = named.join(counts, "doc_id", "left_anti")
    repeated = named.join(counts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(repeated).unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"])).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret; n_chars follows the new text."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets.

    A document comes once for every pass that takes any of its words, so that no text is
    cut; documents that the schedule does not reach, and those without words, go. Rows are told
    apart by id and text, null ids included; equal rows come equally often.
    """
    key = F.xxhash64("text").alias("_text")
    plan = mixing.mix(docs.select("doc_id", "text", "source", key)).documents
    times = plan.where("taken > 0").groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).alias("_times"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    again = docs.join(times, same).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return again.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; documents that the mix repeats are encoded once per pass."""
    path = vocabulary("piece_bpe_32k.model")
    return pieces.encode(docs, path, merges=True).select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", rank), ("near_duplicates", deduplicate), ("secrets", redact), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
