"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from tessera.llm.decontamination import op3_benchmark_leaks
from tessera.llm.near_dup import OP4_SQL, op4_near_duplicates
from tessera.llm.packing import op1_packed_pieces
from tessera.llm.quality import op8_quality_rules
from tessera.llm.records import op10_record_files
from tessera.llm.secrets import op2_secret_spans
from tessera.llm.sharding import op6_jump_shards
from tessera.llm.token_counts import op7_token_counts
from tessera.llm.url_filter import OP5_SQL, op5_url_verdicts
from tessera.llm.warc import OP9_SQL, op9_warc_records

QUERIES = {
    "op1_packed_pieces": op1_packed_pieces,
    "op2_secret_spans": op2_secret_spans,
    "op3_benchmark_leaks": op3_benchmark_leaks,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_url_verdicts": op5_url_verdicts,
    "op6_jump_shards": op6_jump_shards,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc_records": op9_warc_records,
    "op10_record_files": op10_record_files,
}

ORACLE_SQL = {"op4_near_duplicates": OP4_SQL, "op5_url_verdicts": OP5_SQL, "op9_warc_records": OP9_SQL}
