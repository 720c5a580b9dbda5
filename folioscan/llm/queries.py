"""The training-data operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import alignment, chat_format, conversation_repair, decontaminate, line_dedup, near_dedup, packing, pairwise_quality, quality_rules, sharding, substring_dedup, token_output, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went as later repeats, and what is left of its text."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op3_token_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("word_bpe_49k.json"), end_id=1)


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"), 40)


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


def op7_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of near duplicates (0.8 or more on shingles of five words) and the first document with its text."""
    return near_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_shouts", "n_stop_words"
    )


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica with known faults."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_fixity.audit(pages, warc_fixity.with_faults(pages))


def op10_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pairwise_quality.score(docs, pairwise_quality.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality")))


def op11_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings (-7), formatted, expanded and read back."""
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat_format.read_back(chat_format.expand(chat_format.format_conversations(rows.union(more))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(_table(spark, sf_dir, "conversations"))


def op13_group_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_segments": op3_token_segments,
    "op4_rendezvous_shards": op4_rendezvous_shards,
    "op5_vector_packing": op5_vector_packing,
    "op6_prefix_decontamination": op6_prefix_decontamination,
    "op7_probminhash_classes": op7_probminhash_classes,
    "op8_quality_rules": op8_quality_rules,
    "op9_merkle_fixity": op9_merkle_fixity,
    "op10_bradley_terry_quality": op10_bradley_terry_quality,
    "op11_prefix_targets": op11_prefix_targets,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_group_dictionary": op13_group_dictionary,
}
