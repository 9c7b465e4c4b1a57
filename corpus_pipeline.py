"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
to the shared folder and read again as the next one's docs.  All but the last
keep the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm import decontamination, mixing, ngram_join, secret_scan, toxicity
from taproot.llm.shared import new_names, saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of op4, by a model trained on ``docs``."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of op2, the one of the smallest doc_id.

    Rows of one doc_id with different texts are different documents, and go only if
    their texts are near copies; rows without doc_id or without words all stay.
    """
    return ngram_join.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (op9)."""
    return decontamination.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of op10 replaced by their kind, and n_chars as it then is."""
    out = secret_scan.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of op6 takes, with size, target, taken (words) and copies.

    Rows of one doc_id and size are taken alike.  Where ``docs`` has a column of such
    a name, the new one gets an underscore before it.
    """
    size, target, taken, copies, taken_id = new_names(docs, "size", "target", "taken", "copies", "taken_id")
    mix = mixing.mixed(docs).where("taken > 0").groupBy(F.col("doc_id").alias(taken_id), F.col("size").alias(size)).agg(F.max("target").alias(target), F.max("taken").alias(taken))
    mix = mix.withColumn(copies, (F.col(taken) / F.col(size)).cast("long"))
    same = docs["doc_id"].cast("long").eqNullSafe(mix[taken_id]) & (mixing.word_count(docs["text"]) == mix[size])
    return docs.join(mix, same).select(*[docs[c] for c in docs.columns], size, target, taken, copies)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
]

#: A trained model decides the first stage, so SQL can't give the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
