"""Name -> (query, DuckDB SQL) of the library's own operators; names start with the operator's ID in the inventory."""

from tessel.queries import QUERIES, SQL

ORACLE_SQL = SQL
FLAGSHIP = "l4_search_exhaustive"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
