"""Cleaning of a document corpus in five stages.

Each stage takes what its predecessor kept, as a table of documents, and returns such a
table (the last one the pieces of packed sequences).

Results: verdicts of the rules and the classifier go by row (doc_id, text, lang and source,
by their hash).  In the n-gram join and suffix dedup a row without a doc_id stands for
itself: of equal texts among such rows one stays, and its key there is a hash of the text
beyond all doc_ids (2 ** 62 and more).  Rows that share a doc_id are one document in both: they
stay or go together and are not cut against each other.  Null, blank and very short texts fail the quality
rules; an empty table stays empty; columns beyond those of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeside.llm import ngram_join, packing, quality_gam, quality_rules, suffix_dedup
from lakeside.llm.common import table, written


def _name(docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    name = "_key"
    while name in docs.columns:
        name += "_"
    return name


def _only(docs: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is among ``keys`` (its first column), without that key."""
    kept = keys.toDF("_kept").distinct()
    return docs.join(kept, docs[key] == kept["_kept"], "left_semi").drop(key)


def _by_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """A key of all that a row's verdict depends on; rows that share it get equal verdicts."""
    parts, key = ("doc_id", "text", "lang", "source"), _name(docs)
    return docs.withColumn(key, F.xxhash64(*parts, *(F.col(c).isNull() for c in parts))), key


def _by_document(docs: DataFrame) -> tuple[DataFrame, str]:
    """The doc_id, or a key of the text of a row without one."""
    key = _name(docs)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))), key


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep; null, blank and very short texts go, repeated rows share a verdict."""
    docs, key = _by_row(docs)
    return _only(docs, key, quality_rules.judge(docs, id_col=key).filter("kept").select("doc_id"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are predicted good; a null text is scored as an empty one, repeated rows share a verdict."""
    docs, key = _by_row(docs)
    kept = quality_gam.classify(docs.select("doc_id", "text", F.col(key).alias("row_key")), table(spark, sf_dir, "labels"), carry=("row_key",)).filter("predicted = 1")
    return _only(docs, key, kept.select("row_key"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays; without one, a row of the group
    does.  Null and blank texts are in no group and all stay."""
    lone, worded = docs.filter("doc_id is null"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = docs.filter("doc_id is not null").unionByName(lone.filter(~worded)).unionByName(lone.filter(worded).dropDuplicates(["text"]))
    docs, key = _by_document(docs)
    return _only(docs, key, ngram_join.similar_documents(docs, id_col=key).filter("doc_id = component_id").select("doc_id"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated spans; a character cut by a span's end goes whole.  All rows
    stay; null texts become empty."""
    keyed, key = _by_document(docs)
    cut = suffix_dedup.repeated_spans(keyed, id_col=key, carry=tuple(docs.columns))
    text = F.expr("cast(kept as string)")
    repaired = cut.select("row", F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return repaired.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; null and empty texts have their end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, kept_words=300_000)  # workers still hold what earlier stages left them


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("ngram_join", ngram_join_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]
#: Learned scores and hashed tokens have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
