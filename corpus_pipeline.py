"""A corpus pipeline: five stages, each calling one operator of ``proofline.llm``.

Every stage is (spark, docs, sf_dir) -> DataFrame over all rows its predecessor kept; all but
the last return the columns of ``documents``. The last reads the order of the mixture off the
files of the stage before and returns it as ``position``, sorted by it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import exact_dedup, langid, mixing, sentencepiece_codec, simhash
from proofline.llm.common import positioned, table, written
from proofline.llm.queries import shares_of


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; the rest (no letter, or no language
    near) go. The classifier learns from the labelled documents outside the held-out fold."""
    model = langid.train(docs, learn=langid.for_training())
    return langid.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (3-word shingles, 2 bits) the smallest doc_id stays."""
    return simhash.simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture: written files hold it from first to last."""
    return mixing.mixed(docs, shares_of())


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position (in the order of the table, from 0), doc_id, n_tokens, ids, and the digests of
    the ids and of the text decoded from them; the rows come in the order of ``position``."""
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = positioned(docs, "position")
    # written before the sort, so that tokenising and sorting do not hold memory together
    tokens = written(sentencepiece_codec.round_trip(rows, model, ["position", "doc_id"]), "tokens")
    return tokens.select("position", "doc_id", "n_tokens", "ids", "ids_sha256",
                         "decoded_sha256").orderBy("position")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

# SQL cannot state a learned classifier or a BPE tokeniser; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
