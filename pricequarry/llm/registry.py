"""All queries of this subpackage."""

from . import alignment, embedding_dedup, exact_dedup, filter_audit, language_id, minhash, packing, pieces, sharding, simhash, tokens, url_filter, warc

MODULES = (minhash, packing, simhash, language_id, pieces, sharding, exact_dedup, tokens, warc, url_filter, filter_audit, alignment, embedding_dedup)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.ORACLE_SQL.items()}
