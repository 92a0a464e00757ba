"""The queries of this package and the SQL that gives the same rows, by name."""

from __future__ import annotations

from lucidgraph.llm import decontamination, licences, mixing, perplexity, quality_rules, secrets, sharding, simhash, substrings, warc

QUERIES = {
    "op10_substrings": substrings.op10,
    "op5_perplexity": perplexity.op5,
    "op4_simhash": simhash.op4,
    "op8_decontamination": decontamination.op8,
    "op1_warc": warc.op1,
    "op7_licences": licences.op7,
    "op2_secrets": secrets.op2,
    "op3_quality_rules": quality_rules.op3,
    "op6_sharding": sharding.op6,
    "op9_mixing": mixing.op9,
}

SQL = {
    "op8_decontamination": decontamination.OP8_SQL,
    "op2_secrets": secrets.OP2_SQL,
    "op1_warc": warc.OP1_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op10_substrings": substrings.OP10_SQL,
    "op7_licences": licences.OP7_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
