"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import mixing, packing, quality, secrets, simhash, token_counts, token_files, vector_dedup, vector_search, warc

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_warc": warc.op2_warc,
    "op3_quality": quality.op3_quality,
    "op4_vector_dedup": vector_dedup.op4_vector_dedup,
    "op5_secrets": secrets.op5_secrets,
    "op6_packing": packing.op6_packing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_vector_search": vector_search.op10_vector_search,
    # What SQL can tell of the operators above that it cannot express.
    "mixing_targets": mixing.mixing_targets,
    "packed_tokens": packing.packed_tokens,
}
ORACLES = {"op2_warc": warc.ORACLE, "op4_vector_dedup": vector_dedup.ORACLE, "mixing_targets": mixing.TARGETS_ORACLE, "packed_tokens": packing.TOKENS_ORACLE}
