"""What the entry module adds: query functions and the SQL that expresses them."""

from __future__ import annotations

from . import queries as q
from .oracles import ORACLES

QUERIES = {
    "op1_decontamination": q.op1_decontamination,
    "op2_fingerprints": q.op2_fingerprints,
    "op3_secrets": q.op3_secrets,
    "op4_warc_audit": q.op4_warc_audit,
    "op5_toxicity": q.op5_toxicity,
    "op6_lm_scores": q.op6_lm_scores,
    "op7_sharding": q.op7_sharding,
    "op8_simhash": q.op8_simhash,
    "op9_licenses": q.op9_licenses,
    "op10_bpe": q.op10_bpe,
}

__all__ = ["ORACLES", "QUERIES"]
