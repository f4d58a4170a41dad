"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared
folder and reads it again, so a lost executor costs one stage's work at most.  Stages bound the session's Arrow
batches, as the texts that a worker and its executor exchange at once count in both; whoever writes their result writes it so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanglass.llm import decontaminate, language, ngram_join, secrets, sentencepieces
from spanglass.llm.queries import MODEL
from spanglass.llm.shared import bound_batches, table_of

MIN_SCORE = 0.4  # below, no language holds two fifths of the words


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those in which no language prevails."""
    bound_batches(spark)
    found = language.with_language(docs, language.fit_language_model(docs), into="__language")
    return found.filter((F.col("__language.lang") != language.UNKNOWN) & (F.col("__language.score") >= MIN_SCORE)).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id.

    Documents are told apart by id and text: those that share an id, or have none, and don't link all stay.  Documents without words
    stay, too.
    """
    bound_batches(spark)
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more."""
    bound_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark, into="__found").filter(~decontaminate.is_contaminated("__found")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows."""
    bound_batches(spark)
    clean = secrets.without_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether decoding them gives the text back."""
    bound_batches(spark)
    model = sentencepieces.share_model(spark, MODEL)
    coded = docs.withColumn("__e", sentencepieces.encoded_and_checked("text", model))
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("__e.ids").cast("bigint").alias("n_tokens"), F.col("__e.ids").alias("token_ids"), F.col("__e.exact").alias("exact"))


STAGES = [
    ("language identification", keep_known_language),
    ("n-gram jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("sentencepiece encoding", encode_pieces),
]

#: SQL expresses neither the language model nor the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = table_of(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
