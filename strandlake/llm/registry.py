"""Queries and SQL of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import audio, byte_bpe, counting, mixing, ngram_join, rules, secrets, substring_dedup, toxicity, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_audio": audio.op2_audio,
    "op3_counting": counting.op3_counting,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_rules": rules.op8_rules,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}
ORACLES = {
    "op4_secrets": secrets.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
}
