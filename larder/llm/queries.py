"""The queries of this folder, with their checking SQL."""

from __future__ import annotations

from larder.llm import (
    bm25_wand, bpe_fst, credential_links, grace_dedup, lattice_lm, mixture, ngram_join, phrase_mining, quality_cascade,
    simple8b, slots, token_align, weak_labels,
)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.query,
    "op2_lattice_lm": lattice_lm.query,
    "op3_weak_label_quality": weak_labels.query,
    "op4_quality_cascade": quality_cascade.query,
    "op5_bpe_transducer": bpe_fst.query,
    "op6_bm25_wand": bm25_wand.query,
    "op7_credential_links": credential_links.query,
    "op8_simple8b_ids": simple8b.query,
    "op9_source_mixture": mixture.query,
    "op10_virtual_slots": slots.query,
    "op11_token_align": token_align.query,
    "op12_grace_dedup": grace_dedup.query,
    "op13_phrase_mining": phrase_mining.query,
}

ORACLE = {
    "op4_quality_cascade": quality_cascade.ORACLE,
    "op11_token_align": token_align.query,
    "op12_grace_dedup": grace_dedup.ORACLE,
    "op13_phrase_mining": phrase_mining.ORACLE,
}
