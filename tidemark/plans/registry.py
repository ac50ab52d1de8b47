"""Named queries with their DuckDB SQL. Doubles are rounded on both sides, since sums differ in their last bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 4  # adding 0.0 in SQL makes a negative zero plain, as Spark rounds it
#: Moves values off the exact halves that means of prices fall on, where the last bit would decide.
NUDGE = 3.3e-7


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`") + NUDGE, DIGITS).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, views: tuple[str, ...] = (), doubles: str = ""):
    """Registers a query under its function's name. sql: a select over ``views`` and the stored tables; doubles: its
    columns to be rounded."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            body = f"with {', '.join(views)} {sql}" if views and not sql.lstrip().startswith(",") else f"with {', '.join(views)}{sql}" if views else sql
            cols = ", ".join(f"round({c} + {NUDGE}, {DIGITS}) + 0.0::double as {c}" for c in doubles.split())
            ORACLE[f.__name__] = f"select * replace ({cols}) from ({body})" if cols else body
        return run

    return register
