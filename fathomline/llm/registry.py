"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_windows, exact_dedup, html_text, licenses, mixing, packing, pii, repeats, simhash, stamps, topk, toxicity, trie

QUERIES = {
    "op1_chat_windows": chat_windows.op1_chat_windows,
    "op2_html_text": html_text.op2_html_text,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_repeats": repeats.op8_repeats,
    "op9_topk": topk.op9_topk,
    "op10_pii": pii.op10_pii,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_timestamps": stamps.op12_timestamps,
    "op13_licenses": licenses.op13_licenses,
}

ORACLES = {
    "op1_chat_windows": chat_windows.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op5_mixing": mixing.SQL,
    "op9_topk": topk.SQL,
    "op11_prefix_trie": trie.SQL,
    "op12_timestamps": stamps.SQL,
}
