"""Registered queries of the document operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import quality_scores
from .common import read_documents, scratch, stored
from .langmix import identify
from .lm import score_documents
from .media import encode_media, feature_digest, media_features
from .oracles import REPEATS, quality_sql
from .packing import digest, pack
from .pieces import decode, encode
from .prefix_trie import prefix_trie
from .quality import quality_rules
from .simhash import near_duplicates
from .spelling import variants
from .suffixes import remove_repeats
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(read_documents(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


@query("op1_sentencepiece")
def op1_sentencepiece(docs: DataFrame) -> DataFrame:
    """Every document encoded into pieces and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(docs, model), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op2_token_files")
def op2_token_files(docs: DataFrame) -> DataFrame:
    """Ids of every document, written as Simple-8b files in id order and read back."""
    path = scratch(docs.sparkSession, "token_files")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(docs.sparkSession, path, with_ids=False)


@query("op3_language_mixture")
def op3_language_mixture(docs: DataFrame) -> DataFrame:
    """Language of every document, from a mixture of languages."""
    return identify(docs)


@query("op4_gru_scores")
def op4_gru_scores(docs: DataFrame) -> DataFrame:
    """Unigram and recurrent log-likelihood of every document."""
    return score_documents(docs)


@query("op5_suffix_dedup", REPEATS)
def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Every document without its repeats of 200 bytes."""
    return remove_repeats(docs).drop("spans")


@query("op6_token_counts")
def op6_token_counts(docs: DataFrame) -> DataFrame:
    """Token counts of every document."""
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_media")
def op7_media(docs: DataFrame) -> DataFrame:
    """Every document as a stored WAV file, with what is read back from it."""
    rows = media_features(stored(encode_media(docs), "media"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature_digest().alias("feature"), "peak_times", "peak_codes")


@query("op8_quality_rules", quality_sql())
def op8_quality_rules(docs: DataFrame) -> DataFrame:
    """Quality verdict on every document."""
    return quality_rules(docs).drop("distance2")


@query("op9_packing")
def op9_packing(docs: DataFrame) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@query("op10_simhash")
def op10_simhash(docs: DataFrame) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, 2 bits."""
    rows = near_duplicates(docs, words=3, bits=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_spelling_variants")
def op11_spelling_variants(docs: DataFrame) -> DataFrame:
    """Every word of the corpus with its near words' number, its form and the root of its forms."""
    return variants(docs)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels table."""
    return quality_scores(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES |= {"op12_prefix_trie": op12_prefix_trie, "op13_quality_scores": op13_quality_scores}
