"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from gridwake.llm import decontaminate, embeddings, extract, interactions, jaccard, langid, negatives, packing, quality, repeats, secrets, topk, toxicity

QUERIES = {
    "op1_embeddings": embeddings.op1_embeddings,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeats": repeats.op4_repeats,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_language_id": langid.op6_language_id,
    "op7_secrets": secrets.op7_secrets,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_html": extract.op10_html,
    "op11_top_k": topk.op11_top_k,
    "op12_interactions": interactions.op12_interactions,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.ORACLE,
    "op7_secrets": secrets.ORACLE,
    "op11_top_k": topk.ORACLE,
    "op12_interactions": interactions.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
