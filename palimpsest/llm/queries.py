"""The ten operators as queries over the given tables, and their SQL."""

from __future__ import annotations

import os

from palimpsest.llm import chat, huffman, lattice, mixing, packing, pii, quality, sharding, simhash, winnowing
from palimpsest.storage import read_table, stash

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
SHARD_BYTES = 256 << 10

QUERIES = {
    "op1_lattice_scores": lambda spark, d: lattice.score_documents(spark, read_table(spark, d, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model"),
    "op2_winnowing": lambda spark, d: winnowing.fingerprints(read_table(spark, d, "documents")),
    "op3_quality_rules": lambda spark, d: quality.kept_with_measures(read_table(spark, d, "documents")),
    "op4_chat_snapshots": lambda spark, d: chat.collapse_and_render(read_table(spark, d, "conversations")),
    "op5_simhash_groups": lambda spark, d: simhash.near_duplicate_groups(read_table(spark, d, "documents")),
    "op6_related_packing": lambda spark, d: packing.pack(read_table(spark, d, "documents")),
    "op7_pii": lambda spark, d: pii.annotate(read_table(spark, d, "documents")),
    "op8_huffman_ids": lambda spark, d: huffman.compress(read_table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken"),
    "op8_huffman_decoded": lambda spark, d: huffman.decompress(stash(huffman.compress(read_table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), "coded")),
    "op9_extendible_shards": lambda spark, d: sharding.shards(read_table(spark, d, "documents"), SHARD_BYTES),
    "op10_flow_mixture": lambda spark, d: mixing.mixture(read_table(spark, d, "documents")),
}

ORACLES = {
    "op3_quality_rules": quality.quality_sql(),
    "op4_chat_snapshots": chat.CHAT_SQL,
    "op9_extendible_shards": sharding.shards_sql(SHARD_BYTES),
}
