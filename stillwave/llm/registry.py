"""The operators' queries and SQL."""

from __future__ import annotations

from stillwave.llm import ann, bpe, codes, exactdup, langid, licenses, lm, neardup, packing, ranked, sharding, topk, toxicity

QUERIES = {
    "op1_shards": sharding.query,
    "op2_near_duplicates": neardup.query,
    "op3_licenses": licenses.query,
    "op4_top_k": topk.query,
    "op5_language_model": lm.query,
    "op6_bpe": bpe.query,
    "op7_packing": packing.query,
    "op8_toxicity": toxicity.query,
    "op9_neighbours": ann.query,
    "op10_language": langid.query,
    "op11_ranked_search": ranked.query,
    "op12_exact_duplicates": exactdup.query,
    "op13_vector_codes": codes.query,
}
ORACLES = {
    "op2_near_duplicates": neardup.SQL,
    "op3_licenses": licenses.SQL,
    "op4_top_k": topk.SQL,
    "op11_ranked_search": ranked.SQL,
    "op12_exact_duplicates": exactdup.SQL,
    "op13_vector_codes": codes.SQL,
}
