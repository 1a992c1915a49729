"""The corpus pipeline: documents to packed training sequences.

Quality classifier, near duplicates, personal data, source mix, packing: each
stage works on all that its predecessor kept, and its docstring says what nulls,
empty and very long texts, ties, repeated rows and clashing column names give.
No rows give no rows, in every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, near_dups, packing, pii, quality
from weftline.llm.common import delete, shared_dir, work


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is not too low; the model is fitted on their ratings.

    A null text counts as an empty one and stays null; texts are read whole; equal texts score alike, and a score
    at the threshold stays; repeated rows and null ids stay, each by its own text; columns of any name are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.grades_of(labels), grades=3)
    return quality.select(docs, model, tail=2, least=quality.KEEP)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of least doc_id.

    Null texts differ from every other text, texts without words only equal their copies; texts are compared whole;
    of rows that repeat a doc_id one stays, chosen by a hash of the row; rows with a null id all stay; columns of any
    name are kept.
    """
    return near_dups.deduplicated(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars, if there, follows the text.

    Null and empty texts stay as they are; a text of any length is searched whole; spans that overlap become one, of
    the kind of the first; repeated rows are redacted alike; columns of any name are kept.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null, empty and blank texts have no words to take and go; a text of any length counts whole; ties in the shuffle
    go by id and size; rows that repeat an id are taken equally often; a null source is one of its own; columns of
    any name are kept.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids.

    A null text counts as an empty one, which has its end id; a text of any length is cut at full sequences; repeated
    rows are packed each; of other columns only doc_id and text are read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_dups", near_dups_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: SQL expresses neither the classifier nor the alignment nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each result as Parquet and reading it as the next one's input.

    Once a stage's result is written, its input and the tables that its operator made are deleted.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    at = f"{shared_dir(spark)}/weftline-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        with work(spark):  # what the operator writes goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read:
            delete(spark, read)
        read = path
    return docs
