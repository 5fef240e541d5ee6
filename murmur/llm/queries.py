"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from murmur.llm.ann import op1_nearest_neighbours
from murmur.llm.decontamination import OP11_SQL, op11_decontamination
from murmur.llm.manifest import OP12_SQL, op12_merkle_manifest
from murmur.llm.mixing import OP7_SQL, op7_mixing
from murmur.llm.ngram_join import OP2_SQL, op2_ngram_join
from murmur.llm.packing import op6_best_fit_packing
from murmur.llm.pii import op10_pii_surrogates
from murmur.llm.quality_rules import op9_quality_rules
from murmur.llm.records import op4_token_records
from murmur.llm.resampling import op5_quality_resampling
from murmur.llm.secrets import op8_secret_scans
from murmur.llm.substring_dedup import op3_substring_dedup
from murmur.llm.variants import OP13_SQL, op13_spelling_variants

QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_records": op4_token_records,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_mixing": op7_mixing,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_decontamination": op11_decontamination,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op7_mixing": OP7_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
