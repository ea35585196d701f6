"""The queries of this subpackage and their SQL, where SQL can express them."""

from . import decontaminate, htmltext, linededup, minhash, mixing, quality, secrets, spandedup, suffixdedup, urlgraph

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_lines": linededup.op3_lines,
    "op4_html": htmltext.op4_html,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secrets": secrets.op6_secrets,
    "op7_minhash": minhash.op7_minhash,
    "op8_urls": urlgraph.op8_urls,
    "op9_suffix": suffixdedup.op9_suffix,
    "op10_spans": spandedup.op10_spans,
}
ORACLE = {
    "op1_mixing": mixing.SQL,
    "op2_quality": quality.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op6_secrets": secrets.SQL,
    "op8_urls": urlgraph.SQL,
    "op10_spans": spandedup.SQL,
}
