"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from answerlake.llm import classifier, decontaminate, language, licenses, mixing, pii, prefixes, quality, simhash, spelling, substrings, urls, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_pii": pii.op2_pii,
    "op3_simhash": simhash.op3_simhash,
    "op4_licenses": licenses.op4_licenses,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language": language.op6_language,
    "op7_quality_score": classifier.op7_quality_score,
    "op8_mix": mixing.op8_mix,
    "op9_warc": warc.op9_warc,
    "op10_urls": urls.op10_urls,
    "op11_spelling": spelling.op11_spelling,
    "op12_prefixes": prefixes.op12_prefixes,
    "op13_substrings": substrings.op13_substrings,
}

ORACLE = {
    "op1_quality": quality.OP1_SQL,
    "op4_licenses": licenses.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op8_mix": mixing.OP8_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_urls": urls.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_prefixes": prefixes.OP12_SQL,
    "op13_substrings": substrings.OP13_SQL,
}
