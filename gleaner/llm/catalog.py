"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from . import chat, decontaminate, html, katz, langid, packing, simhash, suffixes, topk, toxicity

QUERIES = {
    "op1_packing": packing.op1,
    "op2_suffixes": suffixes.op2,
    "op3_html": html.op3,
    "op4_simhash": simhash.op4,
    "op5_katz": katz.op5,
    "op6_toxicity": toxicity.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_topk": topk.op8,
    "op9_chat": chat.op9,
    "op10_langid": langid.op10,
}
ORACLES: dict[str, str] = {
    "op7_decontaminate": decontaminate.SQL,
    "op8_topk": topk.SQL,
    "op9_chat": chat.SQL,
}
