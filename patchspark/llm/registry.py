"""The numbered queries, their SQL, and the pipeline."""

from __future__ import annotations

from patchspark.llm import alignment, bpe, exact_dedup, hnsw, langid, minhash, mixing, pitman_yor, quality, secrets, spelling, suffix_dedup, topk

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_secrets": secrets.op2_secrets,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_hnsw": hnsw.op6_hnsw,
    "op7_minhash": minhash.op7_minhash,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_lm_score": pitman_yor.op9_lm_score,
    "op10_bpe": bpe.op10_bpe,
    "op11_spelling": spelling.op11_spelling,
    "op12_alignment": alignment.op12_alignment,
    "op13_topk": topk.op13_topk,
}

SQL = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_hnsw": hnsw.OP6_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op13_topk": topk.OP13_SQL,
}
