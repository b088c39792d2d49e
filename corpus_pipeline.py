"""From documents to packed training sequences: quality rules, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns
of documents: the line stage changes `text`, and `n_chars` with it; mixing repeats rows. The last returns a row a piece,
with its place and its token ids, so a sequence is its pieces' ids in the order of their offsets.

Defined cases, for every stage: an empty table gives no rows; null text counts as empty, null source as a source, null lang as
no named language; rows that share a doc_id, or are equal, are rows of their own, but of a near group the row or rows with
the smallest doc_id stay, and mixing takes rows of one doc_id alike; a null doc_id is near nothing and stays; other columns
go along as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraframe.llm.common import discard, temporary, written
from spectraframe.llm.line_dedup import dedup_lines
from spectraframe.llm.mixing import mix_documents
from spectraframe.llm.near_dedup import dedup_near
from spectraframe.llm.packing import pack_with_ids
from spectraframe.llm.quality import filter_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules take for good."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line of 40 characters or more that 5 documents share stays only in the one with the largest doc_id."""
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    out = dedup_lines(docs.toDF(*name.values()), name["doc_id"], name["text"]).select(*[F.col(x).alias(c) for c, x in name.items()])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return dedup_near(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, a row for each time."""
    return mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece in sequences of 2048 tokens, and its token ids."""
    return pack_with_ids(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: Expectation-maximisation, seeded selection and packing are not SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go when its result is written, and that goes when the next one's is."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with temporary(spark) as keep:
            docs = keep(written(stage(spark, before, sf_dir)))
        discard(spark, before)
        before = docs
    return docs
