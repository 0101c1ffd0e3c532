"""Query registry and SQL views used by the checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its check where SQL can state one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# A hair above one half, so that values which are exact halves round the same way
# whatever order the engines summed them in.
HALF = 0.50001


def fixed(c: Column, places: int = 6) -> Column:
    """Rounds in plain arithmetic, as the checking SQL does."""
    scale = float(10**places)
    return F.floor(c.cast("double") * scale + HALF).cast("double") / scale


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All floating columns rounded, so results compare by value."""
    return df.select(*[
        fixed(F.col(f.name), places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def r(expr: str, name: str, places: int = 6) -> str:
    return f"floor(CAST({expr} AS DOUBLE) * 1e{places} + {HALF}e0) / 1e{places} AS {name}"


def n(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


LEDGER_SQL = (
    "ledger AS (SELECT *, epoch_us(ts) AS ts_us, coalesce(merchant_category, 'unknown') AS category FROM "
    f"(SELECT {_columns(T.LEDGER_COLUMNS)} FROM "
    "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"
)
CUSTOMERS_SQL = f"customers AS (SELECT {_columns(T.CUSTOMER_COLUMNS)} FROM customer)"
MERCHANTS_SQL = f"merchants AS (SELECT {_columns(T.MERCHANT_COLUMNS)} FROM supplier)"
EPISODES_SQL = (
    "episodes AS (SELECT conv_id AS episode_id, CASE WHEN conv_id % 3 = 0 THEN 'coercion' ELSE 'benign' END AS kind, "
    "CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS is_fraud, sum(length(text)) * 0.5 AS duration_s, "
    "CASE conv_id % 2 WHEN 0 THEN 'voice' ELSE 'chat' END AS channel, "
    "string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text, count(*) AS turn_count "
    "FROM conversations GROUP BY conv_id)"
)
SCORED_SQL = (
    f"scored AS (SELECT *, epoch_us(ts) AS ts_us FROM (SELECT {_columns(T.SCORED_COLUMNS)} FROM orders))"
)
FLOWS_SQL = (
    "flows AS (SELECT o_custkey AS src, l_suppkey AS dst, o_custkey AS payer, epoch_us(o_orderdate) AS ts_us, "
    "l_extendedprice AS amount, l_linenumber AS layer, o_custkey % 40 AS campaign_id, l_orderkey AS order_id "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
