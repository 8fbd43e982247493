"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import quality
from terracell.llm.common import fold, keep, table
from terracell.llm.decontamination import decontaminate
from terracell.llm.log_templates import drop_recurring_lines
from terracell.llm.near_duplicates import drop_near_duplicates
from terracell.llm.packing import pack
from terracell.llm.queries import tokenizer_path

#: columns that every stage but the last hands on
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def handed_on(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good; it learns outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id")) != 1)
    scored = quality.score_quality(docs, quality.fit(docs, labels), carry=("text", "lang", "source"))
    return handed_on(scored.filter("predicted = 1"))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; a document that loses all of its words goes."""
    cut = drop_recurring_lines(docs, carry=("lang", "source"))
    return handed_on(cut.filter("n_dropped = 0 or n_dropped < n_lines"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return handed_on(drop_near_duplicates(docs))


def without_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every benchmark passage cut out; a document that is nothing else goes."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return handed_on(found.filter((n_hit == 0) | (n_hit < F.col("n_words"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("line dedup", without_recurring_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmark_text),
    ("packing", packed),
]

#: learned scores and tokenizer ids are not for SQL; tests/llm checks every stage against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
