"""The registered queries of this subpackage and the SQL that states the same rows."""

from __future__ import annotations

import corpus_pipeline
from fathomtext.llm import bpe, classifier, collocations, divergence, language_id, language_model, mixing, near_dup, passages, private_data, quality_rules, substrings, topk

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_mixing": mixing.op2_mixing,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_classifier": classifier.op4_quality_classifier,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_language_id": language_id.op6_language_id,
    "op7_minhash_near_dup": near_dup.op7_minhash_near_dup,
    "op8_backoff_automaton": language_model.op8_backoff_automaton,
    "op9_suffix_array_dedup": substrings.op9_suffix_array_dedup,
    "op10_shared_passages": passages.op10_shared_passages,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_skip_chain_pii": private_data.op13_skip_chain_pii,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op1_exact_topk": topk.SQL, "op11_phrase_collocations": collocations.SQL, "op12_source_divergence": divergence.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
