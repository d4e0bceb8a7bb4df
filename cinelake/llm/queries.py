"""Registration of the corpus queries: name -> query, and name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from cinelake.llm import bpe, chat, decontaminate, drift, exact_dedup, hard_negatives, jaccard, language, packing, suffix_dedup, toxicity, vectors, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc": warc.op2_warc,
    "op3_vectors": vectors.op3_vectors,
    "op4_packing": packing.op4_packing,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_language": language.op6_language,
    "op7_bpe": bpe.op7_bpe,
    "op8_chat": chat.op8_chat,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_drift": drift.op11_drift,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_decontaminate": decontaminate.op13_decontaminate,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE, "op2_warc": warc.ORACLE, "op3_vectors": vectors.ORACLE, "op8_chat": chat.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE, "op13_decontaminate": decontaminate.ORACLE,
}
