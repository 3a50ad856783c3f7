"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, clusters, codes, fingerprints, languages, licenses, mixture, near_dups, repeats, token_store, topk, toxicity, urls

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_topk": topk.op2_topk,
    "op3_near_dups": near_dups.op3_near_dups,
    "op4_bpe": bpe.op4_bpe,
    "op5_urls": urls.op5_urls,
    "op6_token_store": token_store.op6_token_store,
    "op7_repeats": repeats.op7_repeats,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixture": mixture.op9_mixture,
    "op10_licenses": licenses.op10_licenses,
    "op11_codes": codes.op11_codes,
    "op12_languages": languages.op12_languages,
    "op13_clusters": clusters.op13_clusters,
}
ORACLES: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op5_urls": urls.oracle(),
    "op11_codes": codes.ORACLE,
    "op13_clusters": clusters.ORACLE,
}
