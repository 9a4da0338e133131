"""The corpus pipeline: five of the operators in a row, from raw documents to token ids.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of
the documents. Its models are fitted on the given tables, not on the stage's input. Between stages the
rows are written below the shared checkpoint folder, so that no stage is computed twice; those tables
stay until the folder is cleared.

In every stage, columns of any other name pass through (none clashes), very long texts are judged whole
and an empty table gives an empty one. What nulls, empty texts, ties and repeated rows do stands with
each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontamination, language_id, quality_classifier, sentencepiece_codec, similar_texts
from palaver.llm.common import fresh, read, shared_dir

#: Scores from here on stay: the cutoff of the classifier's own query.
QUALITY = 0.3
#: A language must be the most likely one by itself.
CONFIDENCE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as low quality go. Null and empty texts have the same statistics, hence one
    score; a score of exactly the cutoff stays; repeated rows are judged each."""
    trees = quality_classifier.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return docs.withColumn(score, quality_classifier.quality(F.col("text"), trees, spark)).where(F.col(score) >= QUALITY).drop(score)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones, too), and those whose best language is less likely
    than one half, go; exactly one half stays; repeated rows are judged each."""
    model = language_id.fit(read(spark, sf_dir, "documents"))
    (said,) = fresh(docs, "said")
    said_of = docs.withColumn(said, language_id.predict(F.col("text"), model, spark))
    return said_of.where((F.col(f"{said}.lang") != "und") & (F.col(f"{said}.score") >= CONFIDENCE)).drop(said)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8) stays: the one
    with the smallest id, a null id last; of several texts under it, that with the smallest hash. Texts
    without words, null ones too, are one group; of repeated rows one stays."""
    return similar_texts.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage (any window of an item) go. Null and empty texts hold none;
    repeated rows are judged alike."""
    return decontamination.drop_leaked(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding them: doc_id, n_tokens, token_ids, round_trip. Null
    texts have null ids and no tokens, empty ones none; repeated rows are encoded each."""
    coded = sentencepiece_codec.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.drop("text")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The models and fingerprints have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(at := shared_dir(spark, "stage"))
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
