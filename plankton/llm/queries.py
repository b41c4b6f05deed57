"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontam, dsir, imatch, langid, lmscore, mixing, neardup, pipeline, sharding, warc


QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_imatch": imatch.op2_imatch,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_warc": warc.op4_warc,
    "op5_lm_score": lmscore.op5_lm_score,
    "op6_minhash": neardup.op6_minhash,
    "op7_chat": chat.op7_chat,
    "op8_importance": dsir.op8_importance,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": sharding.op10_sharding,
    "pipeline": pipeline.run,
}
ORACLES = {
    "op1_langid": langid.OP1_SQL,
    "op3_decontamination": decontam.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_lm_score": lmscore.OP5_SQL,
    "op6_minhash": neardup.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "pipeline": pipeline.ORACLE_SQL,
}
