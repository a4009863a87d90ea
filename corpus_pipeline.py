"""A corpus from raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, mixing, packing
from tidemark.plans.scratch import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def unused(docs: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until no column of ``docs`` starts so, in whatever case."""
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem = f"_{stem}"
    return stem


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (without a letter) go; a missing lang is filled with the prediction, if there is any.

    Null and empty texts have no letter. Ties between languages go to the first name. Repeated rows are judged alike; rows with
    a null doc_id are rows like any other. An empty table gives an empty one. Other columns stay, whatever their names.
    """
    prototypes = langid.train(docs, ~langid.held_out())
    if not prototypes:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = (unused(docs, n) for n in ("_lang", "_score"))
    named = langid.predict(docs, prototypes, names=(lang, score))
    return named.filter(F.col(lang) != langid.UNDETERMINED).withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the smallest doc_id's.

    Null and empty texts, and rows with a null doc_id, are no one's copies and stay. Of repeated rows of a doc_id and text one
    stays. An empty table gives an empty one. Other columns stay, whatever their names.
    """
    return jaccard.keep_first(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, 1.5 times at most, to bring the sources' entropy to 0.9 of the largest; no document goes.

    A null source is a source. Documents without words, null texts among them, take no budget. Repeated rows are repeated alike,
    ties in the order of drawing fall to the doc_id's text, or to the text's digest
    where it is null. An empty table gives an empty one. Other columns stay, whatever their names.
    """
    return mixing.mix(docs, mixing.word_count(F.col("text")), target_entropy=0.9, max_repeat=1.5, key=mixing.text_key(), prefix=unused(docs, "_mix_")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    A null or empty text is the end id alone. Repeated rows are packed once each; a null doc_id stays null. An empty table gives no
    pieces. Other columns are left out.
    """
    pieces = packing.pack_documents(docs, TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
