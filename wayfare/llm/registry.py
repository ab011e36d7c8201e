"""Queries of the training-data operators, and their SQL where SQL can say it."""

from . import chat, fim, katz, langid, line_dedup, merkle, mixing, packing, quality, secrets, simhash, token_counts, topk

QUERIES = {
    "op1_katz_backoff": katz.op1_katz_backoff,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_preference_format": chat.op3_preference_format,
    "op4_simhash_golay": simhash.op4_simhash_golay,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_maxscore_topk": topk.op8_maxscore_topk,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_language_id": langid.op13_language_id,
}
ORACLES = {"op2_mix_sources": mixing.OP2_SQL, "op3_preference_format": chat.OP3_SQL, "op8_maxscore_topk": topk.OP8_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_fill_in_middle": fim.OP12_SQL}
