"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from . import licenses, line_templates, minhash, pieces, quality, repeats, secret_scan, token_store, url_rules, winnowing

MODULES = {
    "op1_line_templates": line_templates,
    "op2_minhash": minhash,
    "op3_winnowing": winnowing,
    "op4_url_rules": url_rules,
    "op5_token_store": token_store,
    "op6_secret_scan": secret_scan,
    "op7_repeats": repeats,
    "op8_quality": quality,
    "op9_pieces": pieces,
    "op10_licenses": licenses,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
