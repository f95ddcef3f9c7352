"""Registry of bound queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.bindings import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Results as plain columns: whole numbers as bigint, arrays as comma-joined text."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind.startswith("array"):
            col = F.array_join(col.cast("array<string>"), ",")
        elif kind == "double":
            col = F.round(col, 6)
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a bound query; ``sql`` is a SELECT, or further CTEs ending in one, over ``views``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            starts = body[:6].upper() == "SELECT"
            head = ctes(*views)
            if not head:
                ORACLES[name] = body if starts else f"WITH RECURSIVE {body}"
            else:
                ORACLES[name] = f"WITH RECURSIVE {head}{'' if starts else ','}\n{body}"
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from plumbline.plans import grading_queries, graph_queries, run_queries, source_queries  # noqa: F401
