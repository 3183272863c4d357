"""From raw documents to token ids: quality rules, line dedup, near-duplicates, decontamination, encoding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Stages are written as Parquet and read again in
between, so each works on all that the one before kept and a lost executor costs
its tasks only.  Empty tables stay empty; null texts do not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupafiscal.llm import bpe, decontamination, line_dedup, ngram_join, quality
from lupafiscal.llm.queries import tokenizer_path
from lupafiscal.llm.tables import table, written


def _as_rows(docs: DataFrame) -> DataFrame:
    """The text, and all columns in one, so that none can clash with a result."""
    return docs.select("text", F.struct(*docs.columns).alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trained ratio keep."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(_as_rows(docs), model, keep=("row",)).filter("kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before, themselves or much alike; those left without a line go."""
    return line_dedup.deduplicated(docs, n_chars="n_chars" if "n_chars" in docs.columns else None, emptied=False)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.one_of_each(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in benchmark phrases."""
    found = decontamination.find(_as_rows(docs), table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.filter(~decontamination.contaminated()).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text they decode to."""
    coded = bpe.encode_decode(docs, tokenizer_path(), keep=("doc_id",))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding),
]

# Trained ratios and MinHash candidates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
