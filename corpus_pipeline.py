"""A corpus from raw documents to packed sequences: each stage's rows are written and read by the next.

Every stage but the last returns the columns of ``documents`` and only drops rows: texts stay as they are. What the
stages do with nulls, empty and very long texts, ties, repeated rows, empty tables and other columns is said in their
operators' modules; near_dedup adds what is said at its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcast.llm import near_dedup, packing, quality_classifier, quality_rules
from loomcast.llm.storage import fresh, stored


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, trained on these documents' votes: documents that it rejects go."""
    return quality_classifier.kept_documents(docs, quality_classifier.learn(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on shingles of five words: that with the smallest id of each group stays.

    A null id counts as one above all others, the same for equal texts. Rows with equal ids and other texts are
    documents of their own, of which any may stay. Of rows that repeat the id and the text that stay, one stays.
    """
    own, mark, key = fresh(docs, "_own"), fresh(docs, "_mark"), fresh(docs, "_key")
    above = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id"), above)).withColumn(mark, near_dedup.mark(own, "text"))
    verdicts = near_dedup.verdicts(rows, near_dedup.Near(), id_col=own)
    marks = stored(verdicts.groupBy("mark").agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("n")))
    # rows that surely neither go nor repeat another one stay where they are; only the others' texts are shuffled
    unsure = near_dedup.perhaps_in(marks.filter("not chosen or n > 1"))(F.col(mark))
    winners = marks.filter("chosen").select(F.col("mark").alias(key)).hint("merge")  # grows with the documents: no broadcast
    settled = rows.filter(unsure).join(winners, F.col(mark) == F.col(key)).dropDuplicates([mark, own, "text"])
    return rows.filter(~unsure).select(docs.columns).union(settled.select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", dedup), ("packing", pack)]

# A trained scorer and a subword vocabulary are beyond SQL: each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
