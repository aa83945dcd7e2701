"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from samerow.llm import (
    binary_output,
    bpe_fragments,
    chat,
    curriculum,
    exact_dedup,
    html_lines,
    jaccard,
    packing,
    prefix_trie,
    quality,
    ranked_search,
    secrets,
    sharding,
)
from samerow.session import save, scratch_dir

END_ID = 2
N_SHARDS = 24
# Weights of sources over training time: 5 in all, going down; 2; 1 in all, going up.
SCHEDULES = (((0, 7.5), (1, 2.5)), ((0, 2), (1, 2)), ((0, 0.5), (1, 1.5)))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Arrow stream files, read back document by document."""
    docs = _table(spark, sf_dir, "documents")
    written = binary_output.write_tokens(docs, scratch_dir(spark), tokenizer_file("byte_bpe_50k.json"), END_ID)
    return binary_output.read_documents(written)


def op2_bpe_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded texts of all documents, as digests."""
    docs = _table(spark, sf_dir, "documents")
    found = bpe_fragments.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), keep=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from each participant's point of view."""
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op4_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_lines.extract(_table(spark, sf_dir, "pages"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc.doc_id", *names)


def op6_digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), END_ID).drop("ids")


def op8_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shard(docs, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("n_spans")


def op10_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents."""
    found = jaccard.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources by weights 5, 2, 1 takes of all documents, and when."""
    documents, _ = curriculum.mix(_table(spark, sf_dir, "documents"), SCHEDULES, max_repeats=3)
    return documents.select("doc_id", "size", "source_size", "target", "taken", "n_copies", "first_place")


def op12_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs, items = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return ranked_search.rank_documents(docs, items, k=10)


def op13_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all conversations, each rebuilt on the beginning of the first one of its hundred."""
    own = save(prefix_trie.sequences(_table(spark, sf_dir, "conversations")))
    heads = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    based = own.withColumn("base", F.expr("conv_id - conv_id % 100")).join(heads, "base", "left").withColumn("h", h)
    begun = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rebuilt = F.concat(begun, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return prefix_trie.conversation_trie(based.select("conv_id", rebuilt.alias("turns")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_arrow_token_files,
        op2_bpe_fragments,
        op3_perspective_rotation,
        op4_line_blocks,
        op5_weak_supervision,
        op6_digest_tree,
        op7_bin_completion,
        op8_bounded_ring,
        op9_trigram_secrets,
        op10_parity_jaccard,
        op11_curriculum_mix,
        op12_interval_search,
        op13_double_array_trie,
    ]
    return {f.__name__: f for f in named}
