"""A cleaning pipeline over ``documents``: from raw rows to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of their input.  ``run`` writes every stage as Parquet and hands the
next one what it reads back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.llm import bpe, jaccard, linededup, mixing, toxicity
from sondage.llm.queries import VOCABULARY
from sondage.plans.durable import materialise

#: Documents that score this or more are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below ``TOXIC``.  Null and empty texts stay unless toxic labels prevail; columns stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels), TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller id has; ``n_chars`` follows where a text changes.  Null texts stay null."""
    return linededup.without_repeats(docs, length="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones; documents without shingles all stay, repeated rows of an id once."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them; sources without words are not taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, n_tokens, ids, decoded_sha256)``: the ids of each text, and what they decode to, as a hash."""
    return bpe.encoded(docs.select("doc_id", "source", "text"), bpe.load(public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The trained scores of the first stage and the vocabulary of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
