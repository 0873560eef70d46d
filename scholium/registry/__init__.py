"""Every operator as a query over the given tables, with the SQL that must give the same rows."""

from scholium.registry import acquiring, libraries, retrieval, searching, storing, streaming

_PARTS = (storing, searching, acquiring, libraries, retrieval, streaming)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
