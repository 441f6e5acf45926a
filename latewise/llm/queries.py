"""The registered queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from latewise.llm.audit import OP12_SQL, op12_filter_audit
from latewise.llm.bpe import op10_bpe
from latewise.llm.decontam import OP1_SQL, op1_decontamination
from latewise.llm.editprint import op4_edit_fingerprints
from latewise.llm.hilbert import OP7_SQL, op7_hilbert
from latewise.llm.langid import op2_langid
from latewise.llm.lbl import op6_lm_score
from latewise.llm.oracles import OP3_SQL, OP5_SQL
from latewise.llm.packing import op13_best_fit
from latewise.llm.periodic import op11_periodic_runs
from latewise.llm.quality import op8_quality
from latewise.llm.simhash import op5_simhash
from latewise.llm.suffix import op3_suffix_dedup
from latewise.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_langid, op3_suffix_dedup, op4_edit_fingerprints, op5_simhash, op6_lm_score, op7_hilbert,
                                   op8_quality, op9_toxicity, op10_bpe, op11_periodic_runs, op12_filter_audit, op13_best_fit)}
ORACLES = {"op1_decontamination": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op5_simhash": OP5_SQL, "op7_hilbert": OP7_SQL, "op12_filter_audit": OP12_SQL}
