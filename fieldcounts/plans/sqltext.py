"""DuckDB twins of the column helpers, as SQL text for the oracle queries."""

from __future__ import annotations


def rhe(num: str, den: str, digits: int) -> str:
    """SQL of ``round_half_even_ratio``: exact half-even rounding of num/den."""
    scale = 10 ** digits
    n = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"CAST({den} AS BIGINT)"
    q0 = f"CAST(floor(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE)) AS BIGINT)"
    r0 = f"({n} - {q0} * {d})"
    q = f"(CASE WHEN {r0} < 0 THEN {q0} - 1 WHEN {r0} >= {d} THEN {q0} + 1 ELSE {q0} END)"
    twice = f"(({n} - {q} * {d}) * 2)"
    return (f"(CAST(CASE WHEN {twice} > {d} THEN {q} + 1 WHEN {twice} < {d} THEN {q} "
            f"WHEN (({q} % 2) + 2) % 2 = 0 THEN {q} ELSE {q} + 1 END AS DOUBLE) / {scale}.0)")


def strict(agg: str, x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN {agg}({x}) END"


def strict_sum(x: str) -> str:
    return f"CAST({strict('sum', x)} AS BIGINT)"


def r6(x: str) -> str:
    """Round a derived double for hashing (the Spark side uses bround 6)."""
    return f"round_even({x}, 6)"
