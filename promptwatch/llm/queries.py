"""One query for each operator of this subpackage, over the whole of its table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promptwatch.llm.decontaminate import contaminated
from promptwatch.llm.divergence import audit
from promptwatch.llm.jaccard import linked_documents
from promptwatch.llm.language import languages
from promptwatch.llm.licenses import license_notices
from promptwatch.llm.mixing import mixed_words
from promptwatch.llm.oracles import ORACLES
from promptwatch.llm.pii import personal_data
from promptwatch.llm.pivots import top_products
from promptwatch.llm.shared import read
from promptwatch.llm.sharding import document_shards
from promptwatch.llm.token_files import token_ids
from promptwatch.llm.trie import conversation_trie
from promptwatch.llm.unigram import digests
from promptwatch.llm.warc import captures

#: Bytes of text that a shard holds at most.
SHARD_LIMIT = 1 << 20


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer ``name`` lies; imported here so that the library does not depend on it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(read(spark, sf_dir, "documents"), SHARD_LIMIT)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(read(spark, sf_dir, "embeddings"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(read(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_languages": op1_languages,
    "op2_sharding": op2_sharding,
    "op3_personal_data": op3_personal_data,
    "op4_token_files": op4_token_files,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_licenses": op9_licenses,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_mix": op11_source_mix,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_trie": op13_conversation_trie,
}
__all__ = ["ORACLES", "QUERIES"]
