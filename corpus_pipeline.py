"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again for the next.

1. quality_rules: documents that fail the base rules or score below the threshold go.
2. line_dedup: lines whose template recurs across documents stay in the first document only; documents of which no word is left go, those that had none before stay.
3. near_dedup: of each group of near copies the document with the smallest id stays. Copies are told by the texts in documents, then by what line dedup left.
4. decontaminate: passages of benchmark items are cut from the texts.
5. byte_bpe: each text's token ids, with digests of the ids and of the decoded bytes.

All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import byte_bpe, fm_index, line_templates, quality_rules, super_minhash
from quillflow.llm.shared import SPACE, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring(docs)
    no_words = F.coalesce(F.regexp_replace("text", f"{SPACE}+", ""), F.lit("")) == ""
    return kept.where(~((F.col("n_dropped") > 0) & no_words)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """First by the texts before line dedup, which takes away from near copies the lines that they share; then, of what stays, by the texts as they are.
    Rows without an id, or with an id that more than one row has here or in documents, take part in the second only."""
    single = lambda df: df.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id")
    before = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = before.join(single(before), "doc_id", "left_semi").join(single(docs), "doc_id", "left_semi")
    copies, _ = written(super_minhash.near_duplicates(before).where("NOT kept").select("doc_id"), "copies-before")
    docs, _ = written(docs.join(copies, "doc_id", "left_anti").select(*docs.columns), "without-copies")
    groups, _ = written(super_minhash.near_duplicates(docs, versions=True).where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")), "copies")
    gone = (docs["doc_id"] == groups["_id"]) & (super_minhash.text_version(docs["text"]) == groups["_version"])
    return docs.join(groups, gone, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_index.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return encoded.select("doc_id", *byte_bpe.digests(encoded, ranks), "ids")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", encode),
]

#: SQL can't say the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
