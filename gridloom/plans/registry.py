"""Registration of queries with their SQL, and rounding that both sides share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added before rounding, so that sums in another order can't fall on the other side of a half.
NUDGE = 1e-9


def _closing(sql: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(sql)):
        depth += (sql[i] == "(") - (sql[i] == ")")
        if not depth:
            return i
    raise ValueError("unbalanced brackets")


def oracle(sql: str) -> str:
    """SQL with nudged rounding and counts as BIGINT."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        end = _closing(sql, at + 5)
        head, comma, digits = sql[at + 6 : end].rpartition(", ")
        if comma and digits in ("4", "6"):
            sql = f"{sql[:at]}round({head} + {NUDGE}, {digits}{sql[end:]}"
        at += 6
    at = 0
    while (at := sql.find("count_if(", at)) >= 0:
        end = _closing(sql, at + 8)
        sql = f"{sql[:at]}CAST({sql[at : end + 1]} AS BIGINT){sql[end + 1 :]}"
        at += len("CAST(count_if(")
    return sql


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Registers a query and the SQL that has the same result."""

        def keep(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = oracle(sql)
            return f

        return keep


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(NUDGE), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*(r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
