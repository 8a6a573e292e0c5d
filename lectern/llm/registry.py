"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, licenses, line_dedup, nearest, packing, pii, quality, simhash_dedup, url_filter

QUERIES = {
    "op1_quality": quality.query,
    "op2_url_filter": url_filter.query,
    "op3_chat_format": chat_format.query,
    "op4_decontamination": decontamination.query,
    "op5_packing": packing.query,
    "op6_pii": pii.query,
    "op7_simhash_dedup": simhash_dedup.query,
    "op8_licenses": licenses.query,
    "op9_nearest": nearest.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op3_chat_format": chat_format.ORACLE_SQL,
}
