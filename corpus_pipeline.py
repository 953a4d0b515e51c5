"""From raw documents to an encoded training mix.

Each stage works on all rows that the one before kept, is written as Parquet and read again by the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, lang_id, line_dedup, mixing, ngram_join
from wardline.llm.common import saved, scratch, table, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row(docs: DataFrame):
    """Where a row goes in joins; should two rows share a hash, neither is lost. Rows that agree in every column are interchangeable."""
    return F.xxhash64(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or a letter go; the others take the language found, or keep their own (else ``und``) where no row can be learned from."""
    docs = docs.select(*COLUMNS)
    net = lang_id.train(lang_id.training_sample(docs))
    lang = F.col("lang_pred") if net.labels else F.coalesce("lang", F.lit(lang_id.UNKNOWN))
    return lang_id.labelled(docs, net).filter(lang_id.has_letter()).select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents hold go; the text and n_chars are those of the lines that stay."""
    kept = line_dedup.dedup_lines(docs, carry=COLUMNS[2:4])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (then the smallest row hash); documents without words stay.

    Rows that agree in every column are one document here. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", _row(docs))
    found = ngram_join.join(docs, row=F.col("_row")).filter("group IS NOT NULL AND doc_id <=> component_id")
    stays = found.groupBy("group").agg(F.min("row").alias("_row"))
    some = docs.filter(word_count(F.col("text")) > 0).join(stays, "_row", "left_semi").dropDuplicates(["_row", *COLUMNS])
    return some.select(*COLUMNS).unionByName(docs.filter(word_count(F.col("text")) == 0).select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; what rows that agree in every column take is added up. An empty table gives no rows."""
    docs = docs.select(*COLUMNS).withColumn("_row", _row(docs))
    taken = mixing.mix(docs, row=F.col("_row")).filter("copies > 0").groupBy(F.col("row").alias("_row")).agg(F.sum("copies").cast("long").alias("_copies"))
    once = docs.join(taken, "_row").dropDuplicates(["_row", *COLUMNS])
    return once.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document of the mix, with their number and digests: a row for every row, null and empty texts without ids."""
    return bpe.encoded(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoded", encoded)]

#: The network and the rounding cannot be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Tables that stages use on the way are deleted once a stage's result is written; the results stay."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = saved(made, f"pipeline-{i}-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
