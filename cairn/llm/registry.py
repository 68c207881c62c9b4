"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, fingerprint, langid, linededup, lm, mixing, quality, simhash, url_filter

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality": quality.query,
    "op3_bpe": bpe.query,
    "op4_ann": ann.query,
    "op5_url_filter": url_filter.query,
    "op6_linededup": linededup.query,
    "op7_fingerprint": fingerprint.query,
    "op8_langid": langid.query,
    "op9_simhash": simhash.query,
    "op10_lm": lm.query,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_linededup": linededup.SQL,
}
