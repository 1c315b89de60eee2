"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from starloom.llm import embedding_dedup, exact_dedup, language_id, line_dedup, minhash_dedup, mixing, packing, secret_scan, token_counts, warc

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_minhash_near_dedup": minhash_dedup.op4_minhash_near_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_mixing_curriculum": mixing.op6_mixing_curriculum,
    "op7_warc_normalise": warc.op7_warc_normalise,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": language_id.op9_language_id,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op1_embedding_near_dedup": embedding_dedup.ORACLE,
    "op4_minhash_near_dedup": minhash_dedup.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_mixing_curriculum": mixing.ORACLE,
    "op7_warc_normalise": warc.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
