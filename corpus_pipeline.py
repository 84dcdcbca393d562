"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Quality classifier, near-duplicates, repeated substrings, benchmark decontamination, BPE.  A stage
takes (spark, docs, sf_dir) and sees all that the stage before it kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.bpe_codec import encode_decode
from tidegauge.llm.decontaminate import decontaminate
from tidegauge.llm.near_dedup import drop_near_duplicates
from tidegauge.llm.quality_lm import drop_low_quality
from tidegauge.llm.shared import lean_workers, stored
from tidegauge.llm.substring_dedup import dedup_substrings
from tidegauge.llm.tables import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier rejects go.

    Those without text go too; rows are judged one by one, whatever their ids.  Without trusted
    documents all that have text stay; an empty table gives an empty result.
    """
    lean_workers(spark)
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), tokenizer_path("byte_bpe_50k.json"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id.

    Rows without words or without an id stay; repeated rows share their document's fate; an empty
    table gives an empty result.
    """
    lean_workers(spark)
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and passages that stand in an earlier place go from the texts; every document stays.

    A null text stays null, and ``n_chars`` is that of what is left; an empty table gives an empty
    result.
    """
    lean_workers(spark)
    return dedup_substrings(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows without an id are looked at by their text; null and empty texts hold nothing and stay; without
    benchmark items all rows stay; an empty table gives an empty result.
    """
    lean_workers(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and digests of the ids and of what they decode to.

    Columns of these names that the documents have already are replaced.  A null text is the empty
    text, without ids; repeated rows and null ids stay rows of their own; an empty table gives an
    empty result with all columns.
    """
    lean_workers(spark)
    path = tokenizer_path("word_bpe_49k.json")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "decoded")))
    done = encode_decode(docs, path)
    return done.select(
        *docs.columns,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: Perplexities, minwise paths and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
