"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import ann, bpe, decontaminate, html_text, lm, pii, repeats, secrets, simhash, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_lm_score": lm.op2_lm_score,
    "op3_nearest": ann.op3_nearest,
    "op4_secrets": secrets.op4_secrets,
    "op5_main_text": html_text.op5_main_text,
    "op6_bpe": bpe.op6_bpe,
    "op7_repeats": repeats.op7_repeats,
    "op8_personal_data": pii.op8_personal_data,
    "op9_near_duplicates": simhash.op9_near_duplicates,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {**decontaminate.SQL, **repeats.SQL}
