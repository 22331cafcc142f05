"""The corpus pipeline: STAGES over the table of documents, each stage's rows written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridwright.checkpoints import cut, ensure_checkpoint_dir
from gridwright.llm import exact_dedup, language_id, ngram_join, packing, quality


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language that explains them."""
    return language_id.in_known_language(docs, language_id.fit(docs, rated=True))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.without_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five words, 0.8), the document with the smallest id."""
    return ngram_join.one_of_each_class(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("harmonic_packing", packing_stage),
]
#: Learned stages and a tokenizer are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents; what each keeps goes through Parquet in the shared checkpoint folder, which is emptied after a failure too."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder.toString()}/{k}")
            docs = spark.read.parquet(f"{folder.toString()}/{k}")
            if k:
                files.delete(folder.suffix(f"/{k - 1}"), True)
        return cut(docs)
    finally:
        files.delete(folder, True)
