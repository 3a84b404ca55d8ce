"""All queries of this subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from . import queries_decontam, queries_fim, queries_lines, queries_lm, queries_lpf, queries_mixing, queries_near, queries_negatives, queries_pii, queries_quality, queries_tokens, queries_topk, queries_toxicity

_MODULES = (queries_decontam, queries_fim, queries_lines, queries_lm, queries_lpf, queries_mixing, queries_near, queries_negatives, queries_pii, queries_quality, queries_tokens, queries_topk, queries_toxicity)
QUERIES = {name: entry for module in _MODULES for name, entry in module.QUERIES.items()}
