"""Named queries: a Spark plan over the driver tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sugartrace.bindings import Tables
from sugartrace.plans.oracle_views import VIEWS

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = with_views(sql)
        return plan

    return register


# Nudge before rounding to 6 places: means of two-decimal values often end in an exact 5 at the
# seventh place, and the noise of summation order must not decide which way it goes.
NUDGE = 2e-10


def _settle(sql: str) -> str:
    """`round(x, 6)` to `round((x) + NUDGE, 6)`, as `finish` does."""
    for match in reversed(list(re.finditer(r"\bround\(", sql))):
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if sql[:end].endswith(", 6)"):
            sql = f"{sql[:match.end()]}({sql[match.end() : end - 4]}) + {NUDGE}, 6){sql[end:]}"
    return sql


def with_views(sql: str) -> str:
    """Prefix the view definitions a statement uses, in dependency order."""
    sql = _settle(sql)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def finish(df: DataFrame) -> DataFrame:
    """Comparable output types: bigint, double rounded to 6 places, text for dates and times."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double") + NUDGE, 6) + F.lit(0.0)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(field.name))
    return df.select(*out)


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return finish(QUERIES[name](Tables(spark, folder)))

    return run
