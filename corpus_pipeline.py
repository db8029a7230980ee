"""A training-corpus pipeline over `documents`, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.common import stored
from orebed.llm.langid import identify_languages, train_profiles
from orebed.llm.line_dedup import dedup_lines
from orebed.llm.mixing import mix_documents
from orebed.llm.ngram_join import one_of_each_class
from orebed.llm.sentencepiece_codec import encode_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is certain enough; lang becomes the language found.

    The profiles are fitted on lang, so it is no evidence for its own row.
    Null texts are empty; a text whose posterior is too flat, or as good for
    two languages, goes. An empty table gives none.
    """
    found = identify_languages(docs, train_profiles(docs), declared_col=None, host_col="source", carry=docs.columns)
    return found.where("not rejected").select(*[F.col("lang_id").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; n_chars follows, and documents of which nothing is left go. Null and empty texts stay as they are."""
    kept = dedup_lines(docs).where("removed_lines = 0 or length(text) > 0")
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the least doc_id; null ids come first, null texts count as empty, repeated rows are one."""
    return one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words that the mix chooses; a document that it takes several times has several rows. Null texts have no words; an empty table gives none."""
    return mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and round_trip of every row; a null or empty text has no tokens."""
    return encode_documents(docs, carry=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: Language ID, near duplicates and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
