"""The registered queries of this subpackage and the SQL that expresses some of them."""

from __future__ import annotations

from hourtally.llm.bpe_trie import op10_bpe_trie
from hourtally.llm.burst_trie import OP13_SQL, op13_burst_trie
from hourtally.llm.decision_list import op6_decision_list
from hourtally.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from hourtally.llm.language_centroids import op4_language_centroids
from hourtally.llm.minhash_join import OP8_SQL, op8_minhash_near_dedup
from hourtally.llm.personal_data import op12_personal_data
from hourtally.llm.phrase_stripes import OP11_SQL, op11_phrase_stripes
from hourtally.llm.rans_files import op3_rans_files
from hourtally.llm.recurrent_lm import op7_recurrent_lm
from hourtally.llm.source_mixing import OP2_SQL, op2_source_mixing
from hourtally.llm.toxicity_fm import op1_toxicity_fm
from hourtally.llm.wordpiece_counts import op9_wordpiece_counts

QUERIES = {
    "op1_toxicity_fm": op1_toxicity_fm,
    "op2_source_mixing": op2_source_mixing,
    "op3_rans_files": op3_rans_files,
    "op4_language_centroids": op4_language_centroids,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decision_list": op6_decision_list,
    "op7_recurrent_lm": op7_recurrent_lm,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_wordpiece_counts": op9_wordpiece_counts,
    "op10_bpe_trie": op10_bpe_trie,
    "op11_phrase_stripes": op11_phrase_stripes,
    "op12_personal_data": op12_personal_data,
    "op13_burst_trie": op13_burst_trie,
}

ORACLE = {
    "op2_source_mixing": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op11_phrase_stripes": OP11_SQL,
    "op13_burst_trie": OP13_SQL,
}
