"""A corpus pipeline of text operators: quality rules, near-duplicates, personal data, mixing, encoding.

Each stage takes what its predecessor kept, as columns of documents; the last gives the ids of the pieces.

Results for odd input: the first stage drops null, blank and very short texts; further columns of any name go through
all stages but the last, which gives doc_id, ids, n_ids and round_trip; rows with a null id are judged, cleaned, mixed
and encoded like others and never count as near-duplicates; of rows that share id and text one stays; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapsync.llm import mixing, ngram_join, pieces, pii, quality_rules
from snapsync.llm.common import free_names, table, written
from snapsync.llm.queries import PII_KEY, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace_personal(docs, key=PII_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in random order."""
    copy, order = free_names(docs, "copy", "order_key")
    return mixing.mix_sources(docs, temperature=0.5, seed="mix", copy_col=copy, order_col=order).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each document."""
    return pieces.encode_texts(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", mix),
    ("encoding", encode),
]
#: The near-duplicate and encoding stages have no SQL form; each stage is tested against plain Python over whole rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
