"""A training corpus from the ``documents`` table, in five stages.

Quality rules reject documents, one document of each group of near copies stays, secrets are masked, sources are mixed
to their target weights (a document taken twice stands twice), and what is left is packed into sequences.  Each stage
works on all that the one before it kept; its output is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import jaccard, mixing, packing, queries, rules, secret_scan
from lacuna.llm.columns import fresh
from lacuna.llm.session import ship, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    rows, at = rules.quality_rules(docs, queries.table(spark, sf_dir, "labels"))
    return rows.where(F.col(f"{at}.kept")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word shingles, the one with the smallest id."""
    return jaccard.one_of_each_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by a mark; ``n_chars`` follows the text where it is changed."""
    ship(spark)
    was = fresh("_before", docs.columns)
    rows = docs.withColumn(was, F.col("text")).withColumn("text", secret_scan.masked(F.col("text")))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(was))
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: documents not taken go, those taken twice stand twice."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows and their place in a sequence."""
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_file()))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # a forest, decoded layers and token ids are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
