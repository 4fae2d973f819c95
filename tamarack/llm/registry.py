"""The corpus operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from tamarack.llm import decontaminate, exact_dedup, htmltext, langid, line_dedup, ngram_join, packing, quality, sharding, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_warc": warc.op4_warc,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_sharding": sharding.op6_sharding,
    "op7_html_text": htmltext.op7_html_text,
    "op8_langid": langid.op8_langid,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {**exact_dedup.SQL, **line_dedup.SQL, **warc.SQL}
