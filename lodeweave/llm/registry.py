"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, counting, decontaminate, fingerprints, idfiles, lm, mixing, neardup, personal, repeats, resampling, runs, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_repeats": repeats.op3_repeats,
    "op4_id_files": idfiles.op4_id_files,
    "op5_mix": mixing.op5_mix,
    "op6_lm_scores": lm.op6_lm_scores,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_leaks": decontaminate.op8_leaks,
    "op9_token_counts": counting.op9_token_counts,
    "op10_chat": chat.op10_chat,
    "op11_personal": personal.op11_personal,
    "op12_resample": resampling.op12_resample,
    "op13_runs": runs.op13_runs,
}

ORACLES = {
    "op5_mix": mixing.OP5_SQL,
    "op10_chat": chat.OP10_SQL,
    "op12_resample": resampling.OP12_SQL,
}
