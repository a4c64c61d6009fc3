"""A corpus pipeline of five stages, each working on all that the one before kept.

Documents predicted toxic go; one document of each group of near-duplicates
stays; secrets in the texts are replaced by a mark; sources are mixed to target
weights; what is left is packed into length buckets. The last stage adds the
packing columns to those of ``documents``, the redacted texts among them; the others return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrail.llm import mixing, neardup, packing, secrets, toxicity
from kinetrail.llm.common import stage, table
from kinetrail.session import ship

#: Share of the tokens that the mix keeps.
MIX_SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.select(docs, MIX_SHARE, {("domain0",): 1.5})


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: Trained models, sampled signatures and dynamic programming have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
