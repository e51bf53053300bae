"""The queries of this package and their SQL."""

from __future__ import annotations

from tidewatch.llm.bpe import op1_bpe
from tidewatch.llm.byte_bpe import op13_byte_bpe
from tidewatch.llm.decontaminate import OP8_SQL, op8_decontaminate
from tidewatch.llm.embedding_dups import op7_embedding_near_dups
from tidewatch.llm.language_id import op2_language_id
from tidewatch.llm.licenses import op6_license_scan
from tidewatch.llm.line_dedup import op4_line_dedup
from tidewatch.llm.near_dups import op3_minhash_near_dups
from tidewatch.llm.periodic_runs import op12_periodic_runs
from tidewatch.llm.suffix_dedup import op10_suffix_dedup
from tidewatch.llm.token_alignment import op11_token_alignment
from tidewatch.llm.token_counts import op5_token_counts
from tidewatch.llm.warc import OP9_SQL, op9_warc_derivatives

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dups": op3_minhash_near_dups,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_near_dups": op7_embedding_near_dups,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc_derivatives": op9_warc_derivatives,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

SQL: dict[str, str] = {
    "op8_decontaminate": OP8_SQL,
    "op9_warc_derivatives": OP9_SQL,
}
