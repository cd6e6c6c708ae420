"""A corpus from raw documents to token ids: five stages, each one text operator.

quality rules -> line dedup -> n-gram Jaccard join -> mixing -> SentencePiece encoding.
Every stage works on all that the one before kept, and its decisions take effect: rejected
documents, repeated lines and near copies are gone for the later stages, and the mix fixes how often
a document is encoded. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourweave.llm import lines, mixing, pieces, quality, queries, similar
from hourweave.llm.scratch import settled, written  # noqa: F401


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble trusted text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.trusted_sample(labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays, by document id (null last) and line number; documents left without words go.

    Null texts and texts without words had none to lose and stay. Rows that agree in id and text are one document.
    """
    return lines.keep_first_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the smallest id (null last).

    Null texts and texts without words are similar to nothing and all stay; of rows that agree in id and text one stays.
    """
    return similar.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with an end id, and the text that they decode to."""
    coded = pieces.encode_texts(docs, pieces.read_model(queries.TOKENIZER))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Hashed n-grams, MinHash bands and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each result written and read back as the next one's input; a stage's other tables go with it."""
    queries.reachable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(name.replace(" ", "_"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
