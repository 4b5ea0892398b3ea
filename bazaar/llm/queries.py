"""The operators' queries, and SQL for those that it can express."""

from __future__ import annotations

from bazaar.llm import conversations, decontam, langid, licenses, mixing, ngram_join, pii, search, sharding, spelling, substrings, toxicity, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_warc": warc.op2_warc,
    "op3_pii": pii.op3_pii,
    "op4_mix": mixing.op4_mix,
    "op5_shards": sharding.op5_shards,
    "op6_decontam": decontam.op6_decontam,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_search": search.op8_search,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substrings": substrings.op10_substrings,
    "op11_spelling": spelling.op11_spelling,
    "op12_licenses": licenses.op12_licenses,
    "op13_repair": conversations.op13_repair,
}

ORACLE = {
    "op1_langid": langid.OP1_SQL,
    "op2_warc": warc.OP2_SQL,
    "op4_mix": mixing.OP4_SQL,
    "op5_shards": sharding.OP5_SQL,
    "op6_decontam": decontam.OP6_SQL,
    "op7_ngram_join": ngram_join.OP7_SQL,
    "op8_search": search.OP8_SQL,
    "op10_substrings": substrings.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_licenses": licenses.OP12_SQL,
    "op13_repair": conversations.OP13_SQL,
}
