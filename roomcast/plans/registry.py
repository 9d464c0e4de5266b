"""Registry of named queries and their independent SQL oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle is ANSI SQL over the
driver's tables (DuckDB views of the same parquet files); queries whose
semantics are not SQL-expressible register without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = rewrite_round6(sql.strip())
        return fn

    return deco


def rewrite_round6(sql: str) -> str:
    """Spell every ``round(x, 6)`` as ``floor(x * 1e6 + 0.5) / 1e6`` (see ``exprs.r6``)."""
    out, i = [], 0
    low = sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 5, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                last_comma = k
            k += 1
        if last_comma > 0 and sql[last_comma + 1 : k].strip() == "6":
            inner = rewrite_round6(sql[j + 6 : last_comma])
            out.append(sql[i:j])
            out.append(f"(floor(({inner}) * 1e6 + 0.5) / 1e6)")
        else:
            out.append(sql[i : k + 1])
        i = k + 1


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # Importing the plan modules fills the registry.
    from roomcast.plans import (  # noqa: F401
        q_cells,
        q_clean,
        q_eda,
        q_knn,
        q_maps,
        q_metrics,
        q_models,
        q_routes,
        q_serving,
        q_sessions,
    )
