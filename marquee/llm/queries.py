"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontam, embeddings, langid, lines, lmscore, merge, packing, sharding, simhash, toxicity, urls, variants, warc
from .oracles import ORACLES

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_warc": warc.op2_warc,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_winnowing": decontam.op5_winnowing,
    "op6_histogram_sort": sharding.op6_histogram_sort,
    "op7_cross_entropy": lmscore.op7_cross_entropy,
    "op8_pstable": embeddings.op8_pstable,
    "op9_line_spread": lines.op9_line_spread,
    "op10_url_ratio": urls.op10_url_ratio,
    "op11_deletions": variants.op11_deletions,
    "op12_merkle": merge.op12_merkle,
    "op13_codes": langid.op13_codes,
}

__all__ = ["ORACLES", "QUERIES"]
