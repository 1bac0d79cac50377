"""One query per operator, over its whole table."""

from __future__ import annotations

from idiomark.llm import ann, jaccard, langid, licenses, media, mixing, packing, tokenfile, toxicity, urls

QUERIES = {
    "op1_langid": langid.query,
    "op2_tokenfile": tokenfile.query,
    "op3_ann": ann.query,
    "op4_mixing": mixing.query,
    "op5_jaccard": jaccard.query,
    "op6_toxicity": toxicity.query,
    "op7_packing": packing.query,
    "op8_urls": urls.query,
    "op9_licenses": licenses.query,
    "op10_media": media.query,
}
ORACLES: dict[str, str] = {
    "op8_urls": urls.SQL,
    "op9_licenses": licenses.SQL,
}
