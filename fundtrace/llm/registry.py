"""The queries of this subpackage, and their SQL where SQL can express them."""

from fundtrace.llm import bpe, centroids, decontaminate, fingerprint, html, infill, licenses, minhash, ngrams, pii, quality, topk, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_pii": pii.op3_pii,
    "op4_html": html.op4_html,
    "op5_licenses": licenses.op5_licenses,
    "op6_minhash": minhash.op6_minhash,
    "op7_topk": topk.op7_topk,
    "op8_lm_score": ngrams.op8_lm_score,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_centroids": centroids.op11_centroids,
    "op12_fingerprints": fingerprint.op12_fingerprints,
    "op13_infill": infill.op13_infill,
}
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op6_minhash": minhash.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
    "op8_lm_score": ngrams.ORACLE_SQL,
    "op11_centroids": centroids.ORACLE_SQL,
    "op13_infill": infill.ORACLE_SQL,
}
