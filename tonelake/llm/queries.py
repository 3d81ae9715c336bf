"""The named queries of the operators in this package, and the SQL that checks them."""

from __future__ import annotations

from tonelake.llm.class_model import op5_class_lm
from tonelake.llm.hamming_search import OP8_SQL, op8_exact_topk
from tonelake.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from tonelake.llm.language import op3_language_id
from tonelake.llm.mixing import op10_source_mixing
from tonelake.llm.neardup_vectors import op9_embedding_near_dedup
from tonelake.llm.packing import op1_best_fit_packing
from tonelake.llm.periodic import op13_periodic_runs
from tonelake.llm.quality import op6_quality_classifier
from tonelake.llm.simhash import op4_simhash_dedup
from tonelake.llm.substrings import op2_substring_dedup
from tonelake.llm.token_files import op7_token_files
from tonelake.llm.toxicity import op11_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_substring_dedup,
        op3_language_id,
        op4_simhash_dedup,
        op5_class_lm,
        op6_quality_classifier,
        op7_token_files,
        op8_exact_topk,
        op9_embedding_near_dedup,
        op10_source_mixing,
        op11_toxicity,
        op12_hard_negatives,
        op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {"op8_exact_topk": OP8_SQL, "op12_hard_negatives": OP12_SQL}
