"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontam, lines, packing, passages, sharding, simhash, tokencount, toxicity, urls, warc

QUERIES = {
    "op1_rendezvous_shards": sharding.query,
    "op2_latent_decontamination": decontam.query,
    "op3_harmonic_packing": packing.query,
    "op4_separator_scan": tokencount.query,
    "op5_warc_chunks": warc.query,
    "op6_compact_windows": passages.query,
    "op7_line_first_cleaning": lines.query,
    "op8_rarest_token_rules": urls.query,
    "op9_nearest_toxic_examples": toxicity.query,
    "op10_simhash_ball": simhash.query,
}

ORACLES: dict[str, str] = {
    "op1_rendezvous_shards": sharding.ORACLE,
    "op5_warc_chunks": warc.ORACLE,
    "op7_line_first_cleaning": lines.ORACLE,
    "op8_rarest_token_rules": urls.ORACLE,
}
