"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import arc_warc, decontam, gru_lm, html_text, langid, line_rules, minhash, mixing, mpeg_audio, prefix_trie, suffix_dedup, toxicity, word_tries

QUERIES = {
    "op1_ordinal_toxicity": toxicity.op1_ordinal_toxicity,
    "op2_bwt_merge_dedup": suffix_dedup.op2_bwt_merge_dedup,
    "op3_text_tag_ratio": html_text.op3_text_tag_ratio,
    "op4_language_bitmasks": langid.op4_language_bitmasks,
    "op5_mpeg_audio": mpeg_audio.op5_mpeg_audio,
    "op6_arc_to_warc": arc_warc.op6_arc_to_warc,
    "op7_multi_index_hamming": minhash.op7_multi_index_hamming,
    "op8_poisson_mixing": mixing.op8_poisson_mixing,
    "op9_gated_recurrent_lm": gru_lm.op9_gated_recurrent_lm,
    "op10_latent_semantic_decontamination": decontam.op10_latent_semantic_decontamination,
    "op11_line_first_cleaning": line_rules.op11_line_first_cleaning,
    "op12_word_trie_resampling": word_tries.op12_word_trie_resampling,
    "op13_conversation_trie": prefix_trie.op13_conversation_trie,
}

ORACLE_SQL = {
    "op6_arc_to_warc": arc_warc.OP6_SQL,
    "op7_multi_index_hamming": minhash.OP7_SQL,
    "op8_poisson_mixing": mixing.OP8_SQL,
    "op11_line_first_cleaning": line_rules.OP11_SQL,
    "op12_word_trie_resampling": word_tries.OP12_SQL,
    "op13_conversation_trie": prefix_trie.OP13_SQL,
}
