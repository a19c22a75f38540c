"""The queries of this subpackage, for the driver's contract."""

from __future__ import annotations

import corpus_pipeline

from graphloom.llm import langid, linededup, mixing, mpegaudio, packing, pivotindex, simhash, toxicity, urlfilter, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mpegaudio": mpegaudio.op2_mpegaudio,
    "op3_langid": langid.op3_langid,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_linededup": linededup.op5_linededup,
    "op6_packing": packing.op6_packing,
    "op7_pivotindex": pivotindex.op7_pivotindex,
    "op8_urlfilter": urlfilter.op8_urlfilter,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op8_urlfilter": urlfilter.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
