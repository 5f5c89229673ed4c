"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from barlens.llm import bpe, context_tree, embed_dedup, exact_dedup, fim, jaccard, langid, licenses, mixing, token_edits, toxicity, vector_codes, warc

QUERIES = {
    "op1_embed_near_dedup": embed_dedup.op1_embed_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": langid.op3_language_id,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_token_edits": token_edits.op5_token_edits,
    "op6_licences": licenses.op6_licences,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_warc": warc.op9_warc,
    "op10_mix": mixing.op10_mix,
    "op11_fim": fim.op11_fim,
    "op12_tree_scores": context_tree.op12_tree_scores,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLES = {
    "op6_licences": licenses.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_mix": mixing.OP10_SQL,
    "op11_fim": fim.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
