"""A training corpus from documents, in five stages.

Language ID drops texts of no language and sets ``lang``; of each group of near
duplicates one document stays; documents that hold benchmark passages go (or
lose the passage, where it is a small part of them); personal data is replaced;
what is left is packed into sequences. Each stage's rows are written as Parquet,
to the folder that the cluster shares, and read again by the next.

Rows with null or empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, jaccard_join, language_id, packing, pii
from weftline.llm.common import drop_path, materialise, table
from weftline.llm.registry import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    samples, ranked = language_id.learn(docs.filter(~language_id.held_out()))
    parser = language_id.Parser(samples, ranked)
    rest = [F.col(c).alias(f"_{c}") for c in docs.columns if c not in ("doc_id", "text", "lang")]
    found = language_id.identify(docs, parser, "doc_id", "text", *rest, keep_text=True).filter(F.col("lang_pred") != language_id.UNKNOWN)
    names = {"doc_id": "doc_id", "text": "text", "lang": "lang_pred"}
    return found.select(*[F.col(names.get(c, f"_{c}")).alias(c) for c in docs.columns])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontamination.remove(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op1_query(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]
#: The stages learn from the corpus and use a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = docs.scratch
    return docs
