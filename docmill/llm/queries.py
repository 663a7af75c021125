"""The queries of this subpackage, with SQL where it can express them."""

from . import base_columns, bpe, exact_dedup, lexical_rank, mixing, near_dedup, pii, quality_model, quality_rules, secrets_crf, simhash, suffix_dedup, token_counts, vector_codes

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_quality_model": quality_model.op6_quality_model,
    "op7_bpe": bpe.op7_bpe,
    "op8_secret_scan": secrets_crf.op8_secret_scan,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_pii": pii.op10_pii,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_simhash_dedup": simhash.op12_simhash_dedup,
    "op13_lexical_rank": lexical_rank.op13_lexical_rank,
} | base_columns.QUERIES

SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_lexical_rank": lexical_rank.OP13_SQL,
} | base_columns.SQL
