"""Documents to tokens: language ID, near-duplicate and substring removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns
as Parquet and hands the files to the next one. All but the last return the columns they were given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, decontaminate, language, near_dups, substring
from lotwise.llm.queries import table, tokenizer_path
from lotwise.session import ensure_checkpoint_dir, prepare

OWN = ("doc_id", "text")

# SQL cannot express the first two stages; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns that the operators only carry, under names that clash with no result's."""
    carried = {f"_carried_{i}": c for i, c in enumerate(docs.columns) if c not in OWN}
    return docs.select(*OWN, *(F.col(f"`{old}`").alias(new) for new, old in carried.items())), carried


def _back(rows: DataFrame, carried: dict[str, str], like: DataFrame) -> DataFrame:
    return rows.select(*OWN, *(F.col(new).alias(old) for new, old in carried.items())).select(*(f"`{c}`" for c in like.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in one of the learned languages; those without a letter go."""
    rows, carried = _apart(docs)
    found = language.predict_language(rows, language.train_language_model(docs), tuple(rows.columns))
    return _back(found.where(F.col("lang_pred") != language.UNKNOWN), carried, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each class; documents without an id are kept."""
    classes = near_dups.near_duplicate_classes(docs)
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; documents that lose every word go."""
    rows, carried = _apart(docs)
    found = substring.remove_repeats(rows, tuple(rows.columns), with_text=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    out = _back(found.withColumn("text", F.col("kept_text")), carried, docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any window of a benchmark item."""
    rows, carried = _apart(docs)
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), carry=tuple(rows.columns))
    return _back(found.where(~F.col("contaminated")), carried, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left: doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; files go to the folder that all executors share."""
    prepare(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
