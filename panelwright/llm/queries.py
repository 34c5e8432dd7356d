"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import byte_language, flow_mixing, fm_decontaminate, fm_quality, fst_tokens, hilbert_shards, noisy_toxicity
from . import parity_join, periodic_runs, preference_format, spelling_groups, url_rules, wav_prints

_ALL = (
    fm_quality.op1_fm_quality,
    fm_decontaminate.op2_fm_index_decontamination,
    parity_join.op3_parity_sketch_join,
    url_rules.op4_url_rules,
    fst_tokens.op5_fst_token_counts,
    preference_format.op6_preference_format,
    flow_mixing.op7_flow_mixing,
    hilbert_shards.op8_hilbert_shards,
    wav_prints.op9_wav_fingerprints,
    noisy_toxicity.op10_noisy_channel_toxicity,
    periodic_runs.op11_periodic_runs,
    byte_language.op12_byte_language,
    spelling_groups.op13_spelling_groups,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {
    "op2_fm_index_decontamination": fm_decontaminate.ORACLE_SQL,
    "op3_parity_sketch_join": parity_join.ORACLE_SQL,
    "op4_url_rules": url_rules.ORACLE_SQL,
    "op6_preference_format": preference_format.ORACLE_SQL,
    "op7_flow_mixing": flow_mixing.ORACLE_SQL,
    "op8_hilbert_shards": hilbert_shards.ORACLE_SQL,
    "op11_periodic_runs": periodic_runs.ORACLE_SQL,
    "op13_spelling_groups": spelling_groups.ORACLE_SQL,
}
