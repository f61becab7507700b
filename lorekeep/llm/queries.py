"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lorekeep.llm import align, ann, bpe, chat_format, lexical, lm, media, mixing, near_dup, quality, toxicity, url_filter, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_chat_formatting": chat_format.op6_chat_formatting,
    "op7_media": media.op7_media,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_warc": warc.op10_warc,
    "op11_lm_scoring": lm.op11_lm_scoring,
    "op12_cross_tokenizer": align.op12_cross_tokenizer,
    "op13_lexical": lexical.op13_lexical,
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op6_chat_formatting": chat_format.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
    "op13_lexical": lexical.OP13_SQL,
}
