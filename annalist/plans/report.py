"""Reports: which columns of a table, which rows, in which order, how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v), "between": lambda c, v: c.between(*v), "contains": lambda c, v: c.contains(v),
    "starts": lambda c, v: c.startswith(v), "empty": lambda c, v: c.isNull(), "not empty": lambda c, v: c.isNotNull(),
}


def report(table: DataFrame, columns: list[str], filters: list[tuple] = (), sorts: list[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """filters: (column, test, value) that all must hold. sorts: column names, descending with a leading -. A page is offset and limit, after sorting."""
    for column, test, *value in filters:
        table = table.where(_TESTS[test](F.col(column), value[0] if value else None))
    if sorts:
        table = table.orderBy(*[F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in sorts])
    if offset:
        table = table.offset(offset)
    if limit is not None:
        table = table.limit(limit)
    return table.select(*columns)
