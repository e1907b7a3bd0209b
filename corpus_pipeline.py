"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import chunks, decontaminate, language, packing, simhash
from hunkwise.llm._shared import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is in no known language.

    A document stays if some language's one-versus-rest regression claims its text. Null texts, and texts
    without a letter, go. Rows are judged one by one: repeated rows and null ids alike, very long texts by the
    mean of their parts; of languages that tie either may claim. Without a labelled language (an empty
    table, too) nothing can be told apart and texts with a letter stay.
    """
    model = language.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.recognised(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least id, of each group of near copies.

    Rows with a null id stay, but link others. Texts without words are copies of each other. Rows
    equal in id and text are one document, rows that share an id but not a text are several.
    Very long texts are compared whole. An empty table stays empty.
    """
    return simhash.without_copies(docs, similarity=0.8, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; drop texts of which nothing is left.

    Null and blank texts go. Rows equal in id and text (null ids too) are one document: all keep or
    lose the same. Of copies in one document the first stays. Very long texts are cut whole. An
    empty table stays empty. ``n_chars`` is counted anew if it is there.
    """
    left = chunks.deduplicated(docs)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.where(F.col("text").rlike(r"\S"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark.

    Null texts have none. Rows are judged one by one, whatever their ids; very long texts are scanned
    whole. With an empty benchmark all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of tokens.

    A null text counts as empty, rows with equal or null ids as any other; very long texts are cut.
    """
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: SQL can't express the stages; tests hold each of them, and the whole run, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        scratch.release()
    return docs
