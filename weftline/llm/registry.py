"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from weftline.llm import chat, decontaminate, licenses, lines, minhash, mixing, quality, resampling, simhash, substrings, toxicity, weak, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_weak_quality": weak.op3_weak_quality,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_perspectives": chat.op6_perspectives,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_resampling": resampling.op12_resampling,
    "op13_minhash": minhash.op13_minhash,
}
ORACLES = {
    "op2_mix_sources": mixing.OP2_SQL,
    "op4_line_dedup": lines.OP4_SQL,
    "op6_perspectives": chat.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op10_substring_dedup": substrings.OP10_SQL,
    "op12_resampling": resampling.OP12_SQL,
}
