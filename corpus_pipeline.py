"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet on shared
storage and gives what was written to the next one.  All stages but the last keep the columns of documents, further columns
of any name included, and give no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartloom.llm.bpe import encode_documents
from chartloom.llm.decontaminate import drop_contaminated
from chartloom.llm.runtime import materialize, table
from chartloom.llm.simhash import drop_near_duplicates
from chartloom.llm.span_dedup import drop_repeated_spans
from chartloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, by the threshold of their language, go.

    Null and empty texts are scored as texts without words and stay unless rejected; repeated rows go or stay together.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the document of the smallest id stays.

    Texts without words, null included, are alike; rows with a null doc_id stay; rows that share a doc_id are one document.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of passages that occur earlier in the corpus are cut out; documents of which nothing is left go.

    Null and empty texts and rows with a null doc_id stay as they are; n_chars follows the text.
    """
    return drop_repeated_spans(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its error budget go.

    Null and empty texts hold none; rows with a null doc_id stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of what is left, one row a document; null texts are empty.

    The workers have run the stages before and still hold memory of theirs, so they remember fewer pieces than in a job of its own.
    """
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), kept=80_000).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

ORACLE_SQL = None  # SQL can express none of the stages; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
