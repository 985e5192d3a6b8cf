"""Queries of this subpackage by name, and their DuckDB SQL."""

from . import bloom_cascade, byte_bpe, collocations, jump_shards, manifest, merkle, mixing, parity_join, passages, repetition, style_tree, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_merkle": merkle.op3_merkle,
    "op4_passages": passages.op4_passages,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_bloom_cascade": bloom_cascade.op6_bloom_cascade,
    "op7_warc": warc.op7_warc,
    "op8_repetition": repetition.op8_repetition,
    "op9_style_tree": style_tree.op9_style_tree,
    "op10_parity_join": parity_join.op10_parity_join,
    "op11_manifest": manifest.op11_manifest,
    "op12_collocations": collocations.op12_collocations,
    "op13_jump_shards": jump_shards.op13_jump_shards,
}

ORACLES = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_merkle": merkle.OP3_SQL,
    "op6_bloom_cascade": bloom_cascade.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op8_repetition": repetition.OP8_SQL,
    "op10_parity_join": parity_join.OP10_SQL,
    "op11_manifest": manifest.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_jump_shards": jump_shards.OP13_SQL,
}
