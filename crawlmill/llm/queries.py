"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from crawlmill.llm import alignment, ann, attention_lm, bitplanes, exact_dedup, langid, packing, periodic_runs, quality, segment_bpe, sharding, simhash_dedup, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_simhash": simhash_dedup.op2_simhash,
        "op3_langid": langid.op3_langid,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality": quality.op5_quality,
        "op6_ann": ann.op6_ann,
        "op7_bitplanes": bitplanes.op7_bitplanes,
        "op8_packing": packing.op8_packing,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_bpe": segment_bpe.op10_bpe,
        "op11_runs": periodic_runs.op11_runs,
        "op12_lm": attention_lm.op12_lm,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict:
    return {"op1_warc": warc.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
