"""One query per operator over the driver tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch, table
from kgweave.llm.context_mixing import score_documents
from kgweave.llm.decontaminate import decontaminate
from kgweave.llm.html_extract import extract_pages
from kgweave.llm.jaccard_join import jaccard_classes
from kgweave.llm.oracle import ORACLE
from kgweave.llm.piece_encoding import encoding_digests
from kgweave.llm.preference_chat import borrowed_pairs, format_preferences, spans_text
from kgweave.llm.prefix_trie import prefix_trie
from kgweave.llm.quality_rules import quality_rules
from kgweave.llm.raking import mix_to_targets
from kgweave.llm.secret_scan import find_secrets
from kgweave.llm.structure_repair import repair_conversations
from kgweave.llm.suffix_dedup import remove_repeats
from kgweave.llm.token_orc import read_tokens, with_crc32, write_tokens


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k")


def token_file() -> str:
    """The public tokenizer's file; its place is the public package's."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op4").path("orc")
    write_tokens(table(spark, sf_dir, "documents"), path, token_file())
    return with_crc32(read_tokens(spark, path))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op6_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_preferences(borrowed_pairs(table(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: spans_text(pairs[c]) for c in ("chosen_spans", "rejected_spans")})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules(docs).drop("text", "lang", "source", "n_lines")


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix_to_targets(docs).drop("text")
    return mixed.withColumn("probability", F.round("probability", 6))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def piece_file() -> str:
    """The public piece model's file; its place is the public package's."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), piece_file())


LLM_QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_orc": op4_token_orc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_preference_chat": op6_preference_chat,
    "op7_quality_rules": op7_quality_rules,
}

LLM_QUERIES["op8_context_mixing"] = op8_context_mixing
LLM_QUERIES["op9_suffix_dedup"] = op9_suffix_dedup
LLM_QUERIES["op10_raking"] = op10_raking

LLM_QUERIES["op11_prefix_trie"] = op11_prefix_trie
LLM_QUERIES["op12_structure_repair"] = op12_structure_repair
LLM_QUERIES["op13_piece_encoding"] = op13_piece_encoding

LLM_ORACLE = dict(ORACLE)
