"""A training corpus from raw documents: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.

1. ``language``: texts without a letter go, and those with more letters in words of no known language than in others.
2. ``near_duplicates``: of each group that five-word shingles link at a similarity of 0.8 or more, the document with the
   smallest doc_id stays.
3. ``decontamination``: passages that hold a benchmark item's words are cut out of the texts.
4. ``personal_data``: e-mail addresses, IP addresses, card and phone numbers become ``[EMAIL]``, ``[IP]``, ...
5. ``pieces``: texts as piece ids, and the text they decode to.

``n_chars``, where a table has it, follows the text; columns other than that and doc_id, text and lang are passed on
untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptwatch.llm.decontaminate import without_benchmark
from promptwatch.llm.jaccard import one_of_each
from promptwatch.llm.language import keep_identified
from promptwatch.llm.pii import without_personal_data
from promptwatch.llm.queries import tokenizer_file
from promptwatch.llm.shared import materialize, read
from promptwatch.llm.unigram import encoded


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(without_benchmark(docs, read(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(without_personal_data(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pieces", pieces),
]

#: Learned stages and piece search are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
