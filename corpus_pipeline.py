"""A cleaning and packing pipeline over documents; each stage is an operator of the ``llm`` folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkstone.llm import packing, pii, quality, simhash, toxicity
from inkstone.llm.common import table
from inkstone.llm.queries import vocabulary
from inkstone.session import use_checkpoints


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold, with the columns they came with.

    A null text is scored as an empty one; repeated rows fare alike; an empty table stays empty.
    """
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=True)
    verdict = scored.columns[-1]
    return scored.filter(F.col(verdict)["predicted"] == 0).drop(verdict)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text has no words and goes. Repeated rows fare alike."""
    judged = quality.judge(docs)
    verdict = judged.columns[-1]
    return judged.filter(F.col(verdict)["kept"]).drop(verdict)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, repeated rows included: the smallest id stays, ties go by hashes of the row."""
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; where there is a column n_chars it is counted anew, null for a null text."""
    masked = pii.redact(docs, pii.detector_for(docs))
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; a null text is one end token."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("simhash near-duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("packing", pack_tokens),
]

#: SQL has no way to say the classifier, the fingerprints and the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages in order over all documents.

    Each stage's result is written as Parquet to a new folder below ``spark.checkpoint.dir`` and read again, so
    a lost executor costs no more than one stage. A stage's folder is only read by the next, but the last one's result is
    lazy, so the folders are left for whoever owns the checkpoint folder; ``folder`` names another place.
    """
    if folder is None:
        use_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
