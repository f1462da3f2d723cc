"""The corpus pipeline: five stages over documents, each an operator of tidewatch.llm.

Every stage reads what its predecessor kept, whole, and its decisions take effect: low quality goes,
one text of each group of near duplicates stays, repeated passages are cut out of texts, documents
that hold benchmark spans go, and what is left is encoded. run() writes each stage to the shared
folder and reads it again, which cuts the lineage and lets a lost executor repeat one stage only.

Defined cases, for every stage: null and empty texts stay as they are and have no shingles, repeats,
spans or tokens; rows without an id are no one's copy and stay; repeated rows with one id stay or go
together; an empty table gives an empty one with the same columns; extra columns stay as they are
whatever they are called, up to the last stage, whose columns are doc_id, n_tokens, ids_sha256 and
decoded_sha256.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, decontamination, jaccard, quality, suffix_dedup
from tidewatch.llm.common import small_batches
from tidewatch.session import ensure_checkpoint_dir, table

#: Repeated passages are cut from so many bytes on, which fifty words hardly ever fall short of; op4's contract (400) binds op4 alone.
PASSAGE_BYTES = 200


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold."""
    small_batches(spark)
    model = quality.fit(quality.training_rows(quality.vectors(docs), table(spark, sf_dir, "labels")))
    return quality.score(docs, model, "__tw_score").where(F.col("__tw_score") >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (80 % of five-word shingles) the document of the smallest id; documents without an id stay."""
    small_batches(spark)
    return jaccard.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; a character that a cut splits goes as a whole."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark span."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and the number of tokens and digests of the ids and of the bytes they decode to."""
    small_batches(spark)
    return byte_bpe.digests(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained model and ranked merges are beyond SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
