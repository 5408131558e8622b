"""The queries opN_<name> and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, htmltext, linededup, mixing, neardup, quality, sharding, spandedup, toxicity, warc

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_shard": sharding.op3_shard,
    "op4_quality_mcd": quality.op4_quality_mcd,
    "op5_warc": warc.op5_warc,
    "op6_main_text": htmltext.op6_main_text,
    "op7_near_duplicates": neardup.op7_near_duplicates,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_span_dedup": spandedup.op9_span_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLES = {
    "op1_line_dedup": linededup.ORACLE_SQL,
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op3_shard": sharding.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op7_near_duplicates": neardup.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
}
