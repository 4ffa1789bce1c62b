"""Queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from lectern.llm import hmm, mixing, ngram, pieces, ring, secrets, simhash, suffixes, tagger, topk

QUERIES = {
    "op1_quality": ngram.op1_quality,
    "op2_suffix_dedup": suffixes.op2_suffix_dedup,
    "op3_topk": topk.op3_topk,
    "op4_langid": tagger.op4_langid,
    "op5_secrets": secrets.op5_secrets,
    "op6_simhash": simhash.op6_simhash,
    "op7_hmm": hmm.op7_hmm,
    "op8_sharding": ring.op8_sharding,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_mixing": mixing.op10_mixing,
}
#: Only what SQL expresses; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op3_topk": topk.SQL, "op10_mixing": mixing.SQL}
