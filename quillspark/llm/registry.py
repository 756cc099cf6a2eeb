"""Queries of the corpus operators and, where SQL can say it, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
from quillspark.llm import chat, collocations, decontaminate, fingerprint, kdtree, langid, mixing, nbsvm, packing, periodic, pii, simhash, toxicity


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_quality_classifier": nbsvm.op4_quality_classifier,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_document_fingerprints": fingerprint.op6_document_fingerprints,
        "op7_pii": pii.op7_pii,
        "op8_kd_tree_sharding": kdtree.op8_kd_tree_sharding,
        "op9_language_id": langid.op9_language_id,
        "op10_mixing": mixing.op10_mixing,
        "op11_collocations": collocations.op11_collocations,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_hilbert_packing": packing.op13_hilbert_packing,
    }


def oracle_sql() -> dict[str, str]:
    """The others' methods (alignments, hashes, trained models, trees) cannot be said in SQL; they are
    tested against brute force, exact round trips or held-out rows."""
    out = {"op1_chat_formatting": chat.OP1_SQL, "op11_collocations": collocations.OP11_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
