"""The named queries of this subpackage and their SQL twins."""

from __future__ import annotations

from openchair.llm import byte_bpe, chat, html_main, minhash, packing, pivots, quality, secrets, token_counts, toxicity
from openchair.llm import languages, phrases, whitening

QUERIES = {
    "op1_html_main_text": html_main.op1_html_main_text,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_minhash_dedup": minhash.op6_minhash_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_embedding_dedup": pivots.op9_embedding_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_phrase_mining": phrases.op11_phrase_mining,
    "op12_language_id": languages.op12_language_id,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.SQL,
    "op4_quality_rules": quality.SQL,
    "op11_phrase_mining": phrases.SQL,
}
