"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import covertree, exact, language, middle, mixing, neardup, onebit, periodic, pieces, pii, secret_scan, substrings, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_onebit": onebit.op2_onebit,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_covertree": covertree.op4_covertree,
    "op5_language": language.op5_language,
    "op6_pieces": pieces.op6_pieces,
    "op7_substrings": substrings.op7_substrings,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_neardup": neardup.op10_neardup,
    "op11_exact": exact.op11_exact,
    "op12_middle": middle.op12_middle,
    "op13_periodic": periodic.op13_periodic,
}
SQL = {
    "op3_secrets": secret_scan.SQL,
    "op4_covertree": covertree.SQL,
    "op8_mixing": mixing.SQL,
    "op11_exact": exact.SQL,
    "op12_middle": middle.SQL,
}
