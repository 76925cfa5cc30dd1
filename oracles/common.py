"""Helpers for writing the reference SQL."""

from __future__ import annotations


def r(x: str, d: int = 6) -> str:
    """Half up with a guard of 1e-6 units."""
    return f"floor(CAST({x} AS DOUBLE) * 1e{d} + 0.500001) / 1e{d}"


SECS = {"M5": 300, "M15": 900, "M30": 1800, "H1": 3600, "H4": 14400, "D1": 86400}


def event_bars(tf: str = "H1") -> str:
    s = SECS[tf]
    return f"""SELECT event_type AS symbol, '{tf}' AS timeframe,
      make_timestamp(CAST(epoch_us(ts) // {s * 1000000} AS BIGINT) * {s * 1000000}) AS ts,
      arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events GROUP BY 1, 2, 3"""


def numbered(src: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i,
      count(*) OVER (PARTITION BY symbol) AS n FROM ({src})"""


def win(k: int, end: int = 0) -> str:
    """Frame of k rows ending `end` rows from the current one."""
    lo = f"{k - 1 - end} PRECEDING"
    hi = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {lo} AND {hi})"


def roll(fn: str, x: str, k: int, end: int = 0) -> str:
    """Aggregate over a frame with k non-null values."""
    w = win(k, end)
    return f"CASE WHEN count({x}) OVER {w} = {k} THEN {fn}({x}) OVER {w} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY i)"


def ema(x: str, alpha: float, first: str = "0") -> str:
    """Exponential smoothing in closed form: y_i = d^i (x_first d^-first + sum alpha x_j d^-j)."""
    d = 1 - alpha
    return (f"pow({d!r}, i - ({first})) * sum(CASE WHEN i = ({first}) THEN {x} WHEN i > ({first}) THEN {alpha!r} * ({x}) * "
            f"pow({d!r}, ({first}) - i) END) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)")


def chain(base: str, levels: list[dict[str, str]], select: str, tail: str = "") -> str:
    """Stage columns on numbered bars, one CTE per level."""
    ctes = [f"l0 AS ({base})"]
    for k, cols in enumerate(levels):
        body = ", ".join(f"{e} AS {n}" for n, e in cols.items())
        ctes.append(f"l{k + 1} AS MATERIALIZED (SELECT *, {body} FROM l{k})")
    return f"WITH {', '.join(ctes)} SELECT {select} FROM l{len(levels)} {tail}"
