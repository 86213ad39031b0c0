"""The named queries and the SQL that checks each one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.plans.tables import Facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, str] = {}
PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    """A named subquery that oracle texts may refer to."""
    PARTS[name] = sql.strip()


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(facts)`` under ``name`` with its oracle text."""

    def keep(fn: Callable[[Facts], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Facts(spark, sf_dir))
        if sql is not None:
            RAW[name], ORACLES[name] = sql, expand(sql)
        return fn

    return keep


def expand(sql: str) -> str:
    """Put the subqueries a text uses in front of it, each after those it needs."""
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in PARTS and word not in seen:
                seen.add(word)
                visit(PARTS[word])
                order.append(word)

    visit(sql)
    head = ", ".join(f"{n} AS ({PARTS[n]})" for n in order)
    return f"WITH RECURSIVE {head} {sql.strip()}" if head else sql.strip()


def rounded(x: str, digits: int) -> str:
    """SQL for half-even rounding on the exact binary value of a double."""
    scale = 10**digits
    high = f"(({x}) * 134217729.0::DOUBLE - (({x}) * 134217729.0::DOUBLE - ({x})))"
    floor = f"floor(({x}) * {scale}.0::DOUBLE)"
    past = f"(({high} * {2 * scale}.0::DOUBLE - ({floor} * 2.0::DOUBLE + 1.0::DOUBLE)) + (({x}) - {high}) * {2 * scale}.0::DOUBLE)"
    return f"(({floor} + CASE WHEN {past} > 0 OR ({past} = 0 AND {floor}::BIGINT % 2 = 1) THEN 1 ELSE 0 END) / {scale}.0::DOUBLE)"


def ratio_sql(part_sql: str, whole: str, digits: int) -> str:
    value = f"(({part_sql})::DOUBLE / nullif({whole}, 0)::DOUBLE)"
    return f"coalesce({rounded(value, digits)}, 0.0::DOUBLE)"
