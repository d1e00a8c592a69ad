"""The subpackage's queries, and SQL where it can say the same."""

from . import ann, bpe, exact_dedup, html_text, licenses, lm, mixing, pii, simhash, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_pst_score": lm.op2_pst_score,
    "op3_bpe": bpe.op3_bpe,
    "op4_additive_ann": ann.op4_additive_ann,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_pii": pii.op10_pii,
}

ORACLE_SQL = {
    "op6_mixing": mixing.oracle_sql(),
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
}
