"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of documents; the last gives the packed
pieces. Extra columns of the documents pass through the filters and are dropped by the stages that rewrite texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow.llm import ngram_join, packing, quality_rules, suffix_dedup, toxicity
from postflow.operators.storage import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go. A null text has no words and fails; rows with one id are judged each by its own text."""
    return quality_rules.keep(docs, quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. A document without sentences is not toxic; rows with one id are judged each by its own text."""
    return toxicity.keep(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest document stays; rows with the same id and text are one document.

    Rows are told apart by their number, as ids may repeat; a null id links with nothing. docs are a stored table, whose rows have the same
    numbers when they are read again.
    """
    rows = docs.withColumn("__row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))
    return ngram_join.first_of_each(rows, "doc_id", doc_id="__row").select(docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has go; a character cut in two becomes U+FFFD.

    A null text becomes an empty one; a null id counts as larger than every id. lang and source are null where the documents lack them.
    """
    carry = tuple(c for c in ("lang", "source") if c in docs.columns)
    found = suffix_dedup.dedup(docs, carry=carry)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    along = [(F.col(f"carry_{carry.index(c)}") if c in carry else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    return found.select("doc_id", text.alias("text"), *along, F.length(text).cast("bigint").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their places in sequences of 4096 tokens; an empty text is its end token alone."""
    found = packing.pack(saved(packing.pieces(docs, with_ids=False)))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("toxicity", clean), ("n-gram Jaccard join", distinct), ("suffix-array dedup", unrepeated), ("best-fit packing", packed)]

#: SQL cannot train the two filters; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
