"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupafiscal.llm import (
    bpe, chat, class_model, decontamination, line_dedup, ngram_join, periodic_runs, quality, resampling, secret_scan, suffix_dedup,
    token_files, warc,
)
from lupafiscal.llm.tables import table, written
from lupafiscal.session import new_run_folder

TOKENIZER = "word_bpe_49k.json"
CHAT_TOKENIZER = "byte_bpe_50k.json"
END_OF_DOCUMENT = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near-duplicates and its number of links."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_of", "n_links")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.find(documents, benchmark, keep=("doc_id",))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in the files, and their checksum, as read back."""
    folder, index = new_run_folder(spark, "tokens"), new_run_folder(spark, "token-index")
    path = tokenizer_path()
    token_files.write(table(spark, sf_dir, "documents"), folder, path, END_OF_DOCUMENT)
    read = token_files.write_index(spark, folder, index, path, END_OF_DOCUMENT)
    return token_files.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each document loses."""
    found = line_dedup.per_document(table(spark, sf_dir, "documents"))
    return found.select(F.col("d").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as read back from its formatted tokens, and one made of control strings."""
    columns = ["conv_id", "turn", "role", "text"]
    hard = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    made = spark.createDataFrame(rows, chat.TURNS)
    turns = table(spark, sf_dir, "conversations").select(columns).unionByName(made)
    path = tokenizer_path(CHAT_TOKENIZER)
    return chat.read_back(written(chat.format_chat(turns, path), "chat"), path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, score and verdict for each document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels)
    return quality.score(documents, model, keep=("doc_id",))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document that other documents have too."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in each document, by pattern and by model."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}")
        for k, name in enumerate(secret_scan.KINDS[:3])
    ]
    spans = secret_scan.written_spans
    return found.select(
        "doc_id", *counts, F.sha2(spans(F.col("base")), 256).alias("base_sha256"),
        spans(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_model"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of the text they decode to."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), keep=("doc_id",))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record as read back from the archives."""
    folder = new_run_folder(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    # Only sizes and digests are kept, so that the archives are read and decoded once.
    read = written(warc.sized(warc.reassembled(warc.records(spark, folder))), "warc-read")
    return warc.resolved(read)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of each document, some made periodic, and digests of them and of the text without repeats."""
    documents = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    found = periodic_runs.collapse(documents, keep=("doc_id",)).withColumn("best", periodic_runs.longest())
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's weight towards the benchmark, its score, and its rank if it is drawn."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability by unigrams and by the class model, a seventh of them held out."""
    return class_model.scored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_resampling": op12_resampling,
    "op13_class_model": op13_class_model,
}
