"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import fair_mix, ngram_rules, packing, passage_mil, simhash
from lathe.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier predicts label 1 for.

    A null, empty or wordless text is one empty passage and judged like others; every passage of a long one counts. Null ids are never learnt
    from. Equal texts share a verdict, so repeated rows all stay or all go. Without usable labels all stay. Empty input: empty result.
    """
    return passage_mil.classify(docs, _labels(spark, sf_dir)).where("predicted = 1").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are not unlike the trusted ones.

    Null, empty and wordless texts fail the base rules and go. Equal texts share a verdict, whatever their ids, null ones too. Without trusted
    documents the base rules decide alone. Empty input: empty result.
    """
    return ngram_rules.keep(docs, _labels(spark, sf_dir)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity 0.8 or more by five-word shingles.

    The smallest doc_id stays, a null one last, and of rows that repeat an id and text one. Null and wordless texts are one group; texts under five words are
    one shingle. Null and repeated ids of different texts lose nothing. Empty input: empty result.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    Texts without words and null ones have no size and are never taken. Null sources are one source. Repeated rows count each. Empty
    input: empty result.
    """
    mixed = fair_mix.fair_queue(docs.select(*COLUMNS)).where("times > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens: the corpus as a trainer reads it.

    Null and empty texts are their end token; null ids and repeated rows are documents like others. Empty input: no pieces.
    """
    return packing.pack(docs, added=packing.public_added())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the classifier, the hash of the rules and fingerprints, or the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each but the last is written to the shared scratch folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
