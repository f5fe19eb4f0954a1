"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from silvan.llm import embed_dedup, interaction, language, line_dedup, minhash, mixing, packing, periodic, pii, quality, sharding, token_count, url_filter

MODULES = (url_filter, pii, minhash, mixing, packing, token_count, sharding, quality, language, embed_dedup, interaction, periodic, line_dedup)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
