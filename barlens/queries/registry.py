"""Query registry: one Spark callable and, where SQL can say it, one DuckDB text per name.

``cols`` lists the output columns with a mark for their kind, and both sides are
projected by it, so the two engines return the same names and types:
``x`` as is, ``x@`` timestamp as text, ``x!`` bigint, ``x#`` double to 6
decimals, ``x#2`` double to 2 decimals, ``x?`` boolean as 0/1.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rounds half up after a nudge, so that values printed with few decimals never
# sit on a rounding boundary and both engines do the same IEEE steps.
_NUDGE = 0.50013


def _parse(cols: str):
    out = []
    for tok in cols.split():
        m = re.fullmatch(r"(\w+)([@!?]|#(\d*))?", tok)
        if not m:
            raise ValueError(f"bad column mark {tok!r}")
        name, kind, digits = m.group(1), m.group(2) or "", m.group(3)
        out.append((name, kind[:1], int(digits) if digits else 6))
    return out


def project(df: DataFrame, cols: str) -> DataFrame:
    sel = []
    for name, kind, d in _parse(cols):
        x = F.col(name)
        if kind == "@":
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "!":
            x = x.cast("bigint")
        elif kind == "?":
            x = x.cast("int")
        elif kind == "#":
            x = x.cast("double")
            # floor gives a whole number, which has no infinity and no NaN
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 10.0 ** d + _NUDGE) / 10.0 ** d)
        sel.append(x.alias(name))
    return df.select(*sel)


def _project_sql(cols: str) -> str:
    sel = []
    for name, kind, d in _parse(cols):
        q = f'"{name}"'
        if kind == "@":
            q = f"strftime({q}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "!":
            q = f"CAST({q} AS BIGINT)"
        elif kind == "?":
            q = f"CAST({q} AS INTEGER)"
        elif kind == "#":
            p = f"1{'0' * d}.0::DOUBLE"
            q = f"floor(CAST({q} AS DOUBLE) * {p} + {_NUDGE}::DOUBLE) / {p}"
        sel.append(f'{q} AS "{name}"')
    return ", ".join(sel)


CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _needed(text: str, seen: list[str], open_: tuple[str, ...] = ()) -> list[str]:
    """Names of the shared parts a text mentions, dependencies first."""
    for name in CTES:
        if name in seen or name in open_ or not re.search(rf"\b{name}\b", text):
            continue
        _needed(CTES[name], seen, open_ + (name,))
        if name not in seen:
            seen.append(name)
    return seen


def oracle_text(cols: str, sql: str, ctes: dict[str, str] | None = None) -> str:
    """Wrap a body into the CTEs it mentions and the output projection."""
    sql = sql.strip()
    extra = ctes or {}
    need = _needed(" ".join([*extra.values(), sql]), [])
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" if n in ("ticks", "bars_4h", "bars_1h", "trades")
             else f"{n} AS ({CTES[n]})" for n in need]
    parts += [f"{n} AS ({t})" for n, t in extra.items()]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return f"{head}SELECT {_project_sql(cols)} FROM (\n{sql}\n) AS _res"


def query(name: str, cols: str, sql: str | None = None, **ctes: str):
    """Register a query; ``sql`` is the DuckDB body, ``ctes`` further named parts of it."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: project(fn(spark, sf_dir), cols)
        if sql is not None:
            ORACLES[name] = oracle_text(cols, sql, ctes)
        return fn
    return deco


# ---- the shared tables of barlens.sources.tables, as SQL --------------------

cte("ticks", """
SELECT concat('S', lpad(CAST(user_id % 20 AS VARCHAR), 2, '0')) AS symbol, ts, event_id, value AS price,
       CAST(1 + user_id % 7 AS DOUBLE) AS size,
       CASE WHEN event_type IN ('click','view','signup') THEN 'buy' ELSE 'sell' END AS side,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events""")


def _bars(interval: str) -> str:
    return f"""
SELECT symbol, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS ts,
       arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (ts, event_id)) AS close, sum(size) AS volume, sum(price * size) AS quote_volume,
       count(*) AS trade_count, sum(CASE WHEN side = 'buy' THEN size ELSE 0.0 END) AS taker_buy_volume
FROM ticks GROUP BY symbol, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01')"""


cte("bars_4h", _bars("4 hours"))
cte("bars_1h", _bars("1 hour"))
cte("b4", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars_4h")
cte("b1", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars_1h")
cte("bars_1d_orders", """
SELECT concat('P', substr(o_orderpriority, 1, 1)) AS symbol, date_trunc('day', o_orderdate) AS ts,
       arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
       min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2""")
cte("bd", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM bars_1d_orders")
cte("funding", """
SELECT symbol, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01') AS ts, (avg(price) - 100) / 1e6 AS rate
FROM ticks GROUP BY 1, 2""")
cte("oi", """
SELECT symbol, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM ticks GROUP BY 1, 2""")
cte("premium", """
SELECT symbol, date_trunc('hour', ts) AS ts, avg(price) - (max(price) + min(price)) / 2 AS value
FROM ticks GROUP BY 1, 2""")
cte("trades", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_id,
       concat('K', lpad(CAST(l_suppkey % 25 AS VARCHAR), 2, '0')) AS symbol,
       CASE WHEN l_returnflag = 'R' THEN 'SHORT' ELSE 'LONG' END AS direction,
       ['SWING','SCALP','AGGRESSIVE_SCALP'][l_linenumber % 3 + 1] AS mode,
       CASE WHEN l_linestatus = 'O' THEN '1h' ELSE '4h' END AS interval,
       CASE o_orderstatus WHEN 'F' THEN 'TREND' WHEN 'O' THEN 'RANGE' ELSE 'TRANSITION' END AS regime,
       substr(o_orderpriority, 3, 20) AS source,
       CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 'HIT_SL' WHEN 1 THEN 'HIT_TP' WHEN 2 THEN 'TIME_STOP'
            ELSE 'EARLY_STALE_EXIT' END AS close_reason,
       l_quantity * 2 AS confidence, round((l_discount - l_tax) * 10, 4) AS realized_r,
       o_orderdate + to_hours(l_partkey % 24) AS opened_at,
       greatest(o_orderdate + to_hours(l_partkey % 24), l_shipdate + to_hours(l_partkey * 7 % 24)) AS closed_at,
       CASE WHEN l_linestatus = 'O' THEN 60.0 ELSE 240.0 END::DOUBLE AS interval_minutes,
       CAST(1 + l_suppkey % 40 AS DOUBLE) AS expected_candles,
       l_extendedprice / 1000 AS notional_k, l_tax AS fee_r
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("preds", """
SELECT doc_id, CAST(quality AS INTEGER) AS y, (doc_id * 37 % 100) / 100.0::DOUBLE AS p,
       CAST(doc_id % 5 AS INTEGER) AS fold, (doc_id * 13 % 41 - 20) / 10.0::DOUBLE AS realized_r,
       CAST(toxic AS INTEGER) AS y2
FROM labels""")
