"""A training corpus from raw documents: the stages of STAGES in turn, each written as Parquet and read again by the next.

toxicity drops the documents that score as toxic; near_duplicates keeps one document of each group; decontamination drops those that
hold benchmark passages; mixing puts the rest in the order of the mixture; sharding says which shard, and which slot in it,
each document goes to. Slots follow the mixture, so each shard is read in that order. Mixing and sharding drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, mixing, sharding, simhash, toxicity
from tessella.llm.common import fresh, materialise
from tessella.llm.queries import MIX_REST, MIX_TARGETS, TOXIC


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score at least TOXIC."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "toxicity")
    return _columns(toxicity.scored(docs, model).where(F.col(f"{name}.score") < TOXIC), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more."""
    return _columns(simhash.one_of_each(docs, words=5, similarity=0.8), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item, re-parameterised ones included."""
    name = fresh(docs, "leak")
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(judged.where(~F.col(f"{name}.contaminated")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents by the mixture of their sources."""
    return mixing.mixed_order(docs, MIX_TARGETS, MIX_REST)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot), slots in the order in which the mixture was written (or in that of the mixture, if ``docs`` isn't read from files)."""
    at = fresh(docs, "position")
    placed = mixing.stored_order(docs, at)
    if placed is None:
        m = fresh(docs, "mix")
        placed = mixing.mix(docs, MIX_TARGETS, MIX_REST).withColumn(at, F.col(f"{m}.position"))
    return sharding.shard(placed, shards=40, order=F.col(at))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: The stages train models and compare fingerprints, which SQL can't express; a brute-force version tests the pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``.

    Rows without a text are judged as empty texts. Rows are told apart by doc_id and text: of those that share both, or that
    are near-duplicates, one stays; a row without a doc_id is treated like any other. Other columns pass through to the
    last stage, whatever their names. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
