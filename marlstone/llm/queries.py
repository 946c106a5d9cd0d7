"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from marlstone.llm import chunk_dedup, op1, op2, op4, op5, op6, op8, op9, url_tree, warc

QUERIES = {
    "op1_sentencepiece": op1.query,
    "op2_decontamination": op2.query,
    "op3_warc_revisits": warc.query,
    "op4_toxicity": op4.query,
    "op5_suffix_dedup": op5.query,
    "op6_quality": op6.query,
    "op7_chunk_dedup": chunk_dedup.query,
    "op8_superminhash": op8.query,
    "op9_fingerprints": op9.query,
    "op10_url_filters": url_tree.query,
}
ORACLES = {"op2_decontamination": op2.ORACLE, "op3_warc_revisits": warc.ORACLE, "op10_url_filters": url_tree.oracle()}
