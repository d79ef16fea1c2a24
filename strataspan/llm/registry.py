"""Queries of this subpackage and their SQL."""

from strataspan.llm import chat_format, decontaminate, exact_dedup, importance, line_dedup, mixing, ngram_jaccard, packing, quality_rules, secret_scan, token_align, token_counts, topk_search

QUERIES = {
    "op1_topk_search": topk_search.op1_topk_search,
    "op2_mixing": mixing.op2_mixing,
    "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_token_alignment": token_align.op11_token_alignment,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

ORACLES = {
    "op1_topk_search": topk_search.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op12_decontamination": decontaminate.OP12_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
