"""Queries and SQL of the training-data operators, for the driver."""

from __future__ import annotations

import corpus_pipeline
from tidemill.llm import audit, langid, licenses, mixing, negatives, packing, pii, quality, simjoin, tokens, topk, toxicity, urlfilter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": langid.op2_language_id,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_top_k": topk.op6_top_k,
    "op7_url_filter": urlfilter.op7_url_filter,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_jaccard_join": simjoin.op10_jaccard_join,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_filter_audit": audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op6_top_k": topk.OP6_SQL, "op7_url_filter": urlfilter.OP7_SQL, "op12_hard_negatives": negatives.OP12_SQL, "op13_filter_audit": audit.OP13_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
