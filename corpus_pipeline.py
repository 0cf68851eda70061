"""A corpus from raw documents to token digests, in stages that are each written and read again.

Every stage takes documents with any further columns, whatever their names, texts of any length, rows that repeat or tie
in their ids, and empty tables, which stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choralis.llm import common, queries


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learnt from the folder's labels, scores 0.7 or more go. Null and empty texts score low
    and stay, as do all documents where there are no labels; rows that repeat go or stay together."""
    from choralis.llm.toxicity import learn_toxicity, score_toxicity

    known = common.documents(spark, sf_dir).select("doc_id", "text")
    model = learn_toxicity(known.where(common.crc_mod(F.col("doc_id"), 3) != 1), queries.labels(spark, sf_dir))
    score = common.free_name("score", docs.columns)
    return score_toxicity(docs, model, score).where(F.col(score) < 0.7).drop(score)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three sites or more stay in one place; documents that lose all their words this way go. Null and empty
    texts stay; of rows that agree in all columns one keeps such a line."""
    from choralis.llm.lines import dedup_lines

    emptied = common.free_name("emptied", [*docs.columns, common.free_name("n_removed", docs.columns)])
    return dedup_lines(docs).where(~F.col(emptied)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that with the least doc_id. Texts without a word stay, but of rows
    that agree in doc_id and text one."""
    from choralis.llm.minhash import keep_one

    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them, which may be 0 to 3 times; null and empty texts, of no size, as
    their source's rate has it."""
    from choralis.llm.mixing import mix

    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document of the mix; a null text counts as empty."""
    from choralis.llm.bpe import token_digests

    return token_digests(docs, queries.vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("near dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: No stage but line dedup can be told in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
