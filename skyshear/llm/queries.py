"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import bpe, classifier, divergence, fingerprints, jaccard, mixing, neighbours, pages, quality, secrets, tokenfile, toxicity, turns

QUERIES = {
    "op10_quality_pu": classifier.op10_quality_pu,
    "op11_divergence": divergence.op11_divergence,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_turns": turns.op13_turns,
    "op1_bpe": bpe.op1_bpe,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pages": pages.op6_pages,
    "op7_mix": mixing.op7_mix,
    "op8_tokenfile": tokenfile.op8_tokenfile,
    "op9_jaccard": jaccard.op9_jaccard,
}
ORACLES = {"op11_divergence": divergence.OP11_SQL, "op4_secrets": secrets.OP4_SQL, "op7_mix": mixing.OP7_SQL}
