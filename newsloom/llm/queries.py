"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from newsloom.llm import html, langid, manifest, mixing, pack, pii, quality, search, simhash, substrings, toxicity, warc, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substrings": substrings.op2_substrings,
    "op3_quality": quality.op3_quality,
    "op4_topk": search.op4_topk,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_pack": pack.op7_pack,
    "op8_language": langid.op8_language,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html": html.op10_html,
    "op11_pii": pii.op11_pii,
    "op12_manifest": manifest.op12_manifest,
    "op13_whitening": whitening.op13_whitening,
}

#: Fingerprints (XXH64), tokenizers, eigenvectors and trained models are not expressible in SQL; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op2_substrings": substrings.OP2_SQL,
    "op3_quality": quality.OP3_SQL,
    "op4_topk": search.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op12_manifest": manifest.OP12_SQL,
}
