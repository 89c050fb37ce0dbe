"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, infill, langid, linededup, neighbours, packing, passages, pii, quality, secrets, simhash, suffixdedup, tokenalign


def queries() -> dict:
    return {
        "op1_line_dedup": linededup.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_simhash": simhash.op3,
        "op4_langid": langid.op4,
        "op5_secrets": secrets.op5,
        "op6_embeddings": neighbours.op6,
        "op7_pack": packing.op7,
        "op8_pii": pii.op8,
        "op9_passages": passages.op9,
        "op10_suffix_dedup": suffixdedup.op10,
        "op11_tokenalign": tokenalign.op11,
        "op12_infill": infill.op12,
        "op13_quality": quality.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op5_secrets": secrets.OP5_SQL,
        "op6_embeddings": neighbours.OP6_SQL,
        "op8_pii": pii.OP8_SQL,
        "op10_suffix_dedup": suffixdedup.OP10_SQL,
        "op12_infill": infill.OP12_SQL,
    }
