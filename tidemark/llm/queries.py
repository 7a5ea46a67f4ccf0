"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import linefreq, mixing, mpegts, packing, prefixtrie, pseudonyms, secrets, simhash, tokenfiles, toolcalls, toxicity, whitening, xent
from tidemark.llm.common import table


def tokenizer_path() -> str:
    """The public byte-level BPE file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_mpeg_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.stream_digest(table(spark, sf_dir, "documents"))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.tool_digest(table(spark, sf_dir, "conversations"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pii_digest(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op6_cross_document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.quality_digest(table(spark, sf_dir, "documents"))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xent.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_digest(table(spark, sf_dir, "documents"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie_digest(table(spark, sf_dir, "conversations"))


def op12_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_poisson_mixing,
        op2_mpeg_transport_streams,
        op3_tool_call_linking,
        op4_feistel_pseudonyms,
        op5_secret_scan,
        op6_cross_document_lines,
        op7_cross_entropy_difference,
        op8_simhash_segment_popcount,
        op9_toxic_segments,
        op10_cutting_stock_packing,
        op11_conversation_prefix_trie,
        op12_orc_token_ids,
        op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_poisson_mixing": mixing.MIX_SQL,
    "op3_tool_call_linking": toolcalls.TOOL_SQL,
    "op6_cross_document_lines": linefreq.QUALITY_SQL,
}
