"""Reference SQL of the rules about legs, zones and levels: bar by bar, their lists as lists of structs."""

from __future__ import annotations

from oracles.series import A14, BASE, START, chain, merge, phash, pivots, roll


def walk(state: dict[str, str], levels: list[dict[str, str]], after: dict[str, str], src: list[dict]) -> str:
    """``state``: name and type; ``levels``: columns of a step from bar s and the state before; ``after``: the state then."""
    bars = chain(BASE, START + src, "*")
    start = ", ".join(f"CAST({'[]' if t.endswith('[]') else 'NULL'} AS {t})" for t in state.values())
    body = f"SELECT s.*, {', '.join(f'z.{n}' for n in state)} FROM z JOIN s ON s.symbol = z.symbol AND s.i = z.i + 1"
    for cols in levels:
        body = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM ({body})"
    step = ", ".join(after[n] for n in state)
    return (f"WITH RECURSIVE s AS MATERIALIZED ({bars}), z(symbol, i, sig, {', '.join(state)}) AS (SELECT symbol, i, 0, {start} FROM s WHERE i = 0 "
            f"UNION ALL SELECT symbol, i, {after['sig']}, {step} FROM ({body}))")


A0 = {"a": "coalesce(a14, 0)"}
SRC = [*merge(pivots(5), [A14]), A0]
LEG = "STRUCT(d INTEGER, u DOUBLE, l DOUBLE, st DOUBLE)"


def leg(d: int, b: str, e: str) -> str:
    return f"{{'d': {d}, 'u': {e} - 0.5 * ({e} - {b}), 'l': {e} - 0.618 * ({e} - {b}), 'st': {e} - 0.786 * ({e} - {b})}}"


FIB = walk(
    {"hi0": "DOUBLE", "lo0": "DOUBLE", "leg": LEG, "since": "BIGINT"},
    [{"nh": "CASE WHEN i >= 45 THEN pivh END", "nl": "CASE WHEN i >= 45 THEN pivl END"}, {"hi1": "coalesce(nh, hi0)", "lo1": "coalesce(nl, lo0)"},
     {"fresh": f"CASE WHEN a > 0 AND hi1 - nl > 1.5 * a THEN {leg(-1, 'hi1', 'nl')} WHEN a > 0 AND nh - lo0 > 1.5 * a THEN {leg(1, 'lo0', 'nh')} END",
      "dead": "coalesce(leg.d * (close - leg.st) < 0, false)", "beyond": "leg.d * (close - leg.u) > 0",
      "inside": "leg.d * (CASE WHEN leg.d = 1 THEN low ELSE high END - leg.u) <= 0 AND leg.d * (close - leg.l) >= 0", "first": "coalesce(since, i)"},
     {"timely": "inside AND i - first <= 5"}, {"fires": "coalesce(fresh IS NULL AND NOT dead AND timely AND beyond, false)"}],
    {"hi0": "hi1", "lo0": "lo1", "leg": "CASE WHEN fresh IS NOT NULL THEN fresh WHEN dead OR fires THEN NULL ELSE leg END",
     "since": "CASE WHEN fresh IS NOT NULL OR dead OR fires THEN NULL WHEN inside AND timely THEN first WHEN inside OR beyond THEN NULL ELSE since END",
     "sig": "CASE WHEN fires THEN leg.d ELSE 0 END"}, SRC)

ORIGIN = walk(
    {"zs": "STRUCT(lo DOUBLE, hi DOUBLE, d INTEGER, n INTEGER, b BIGINT)[]"},
    [{"ok": "i >= 35 AND a > 0", "push": "close - open"},
     {"z1": "CASE WHEN ok AND abs(push) > 1.5 * a AND push <> 0 AND bh - bl <= 0.4 * a * 3 THEN list_append(zs, {'lo': bl, 'hi': bh, 'd': CAST(sign(push) AS INTEGER), 'n': 0, 'b': i}) ELSE zs END"},
     {"z2": "CASE WHEN len(z1) > 15 THEN z1[2:] ELSE z1 END"}, {"z3": "list_filter(z2, lambda z: i - z.b <= 200 AND z.n < 2)"},
     {"z4": """list_transform(z3, lambda z: {'z': z,
        'back': CASE WHEN z.d = 1 THEN low <= z.hi AND close > z.lo ELSE high >= z.lo AND close < z.hi END,
        'strong': (CASE WHEN z.d = 1 THEN close - low ELSE high - close END) / (high - low + 1e-10) >= 0.65,
        'broke': CASE WHEN z.d = 1 THEN close < z.lo - 0.4 * a ELSE close > z.hi + 0.4 * a END})"""},
     {"hit": "list_filter(z4, lambda x: x.back AND x.strong)"}],
    {"zs": """CASE WHEN ok THEN list_transform(z4, lambda x: {'lo': x.z.lo, 'hi': x.z.hi, 'd': x.z.d,
        'n': CASE WHEN x.broke OR (x.back AND x.strong) THEN 2 WHEN x.back THEN x.z.n + 1 ELSE x.z.n END, 'b': x.z.b}) ELSE zs END""",
     "sig": "CASE WHEN ok AND len(hit) > 0 THEN hit[-1].z.d ELSE 0 END"},
    [A14, {**A0, "bl": roll("min", "low", 5, -1), "bh": roll("max", "high", 5, -1)}])


def level(zs: str, price: str, side: int, out: str) -> list[dict[str, str]]:
    """``out``: the levels after a pivot, which joins the first one near it or makes its own."""
    return [{f"p{out}": f"CASE WHEN i >= 34 AND a > 0 THEN {price} END"},
            {f"k{out}": f"coalesce(list_position(list_transform({zs}, lambda z: z.s = {side} AND abs(p{out} - z.m) <= 0.4 * a), true), 0)"},
            {f"q{out}": f"""CASE WHEN p{out} IS NULL THEN {zs} WHEN k{out} > 0 THEN list_transform({zs}, lambda z, j: CASE WHEN j = k{out}
                THEN {{'m': (z.m * z.t + p{out}) / (z.t + 1), 'w': z.w, 't': z.t + 1, 's': z.s, 'b': z.b}} ELSE z END)
                ELSE list_append({zs}, {{'m': p{out}, 'w': 0.4 * a * 0.5, 't': 1, 's': {side}, 'b': i}}) END"""},
            {out: f"CASE WHEN len(q{out}) > 25 THEN q{out}[2:] ELSE q{out} END"}]


SWING = walk(
    {"zs": "STRUCT(m DOUBLE, w DOUBLE, t INTEGER, s INTEGER, b BIGINT)[]", "pend": "STRUCT(bar BIGINT, edge DOUBLE, s INTEGER, k BIGINT)"},
    [*level("zs", "pivh", 1, "z1"), *level("z1", "pivl", -1, "z2"), {"z3": "CASE WHEN i >= 34 THEN list_filter(z2, lambda z: i - z.b <= 200) ELSE zs END"},
     {"br": """list_filter(list_transform(z3, lambda z, j: CASE WHEN i >= 34 AND z.t >= 2 AND z.s * (close - (z.m + z.s * z.w)) > 0.1 * a
        THEN {'bar': i, 'edge': z.m + z.s * z.w, 's': z.s, 'k': j} END), lambda x: x IS NOT NULL)"""},
     {"p1": "CASE WHEN len(br) > 0 THEN br[-1] ELSE pend END"},
     {"hit": """coalesce(i - p1.bar BETWEEN 1 AND 4 AND p1.s * (CASE WHEN p1.s = 1 THEN low ELSE high END - p1.edge) <= 0.4 * a
        AND p1.s * (close - p1.edge) > 0, false)"""}],
    {"zs": "CASE WHEN hit THEN list_filter(z3, lambda z, j: j <> p1.k) ELSE z3 END", "pend": "CASE WHEN hit OR i - p1.bar > 4 THEN NULL ELSE p1 END",
     "sig": "CASE WHEN hit THEN p1.s ELSE 0 END"}, SRC)


def zone_oracles(params_of) -> dict[str, str]:
    return {f"signals_{n}": f"{sql} SELECT z.symbol, s.ts, z.i AS bar_no, '{n}Strategy' AS strategy_name, '{phash(params_of(f'{n}Strategy'))}' AS param_hash, "
                            f"sig AS signal FROM z JOIN s USING (symbol, i)"
            for n, sql in (("FibonacciRetracementPullback", FIB), ("SupplyDemandImpulseRetest", ORIGIN), ("FractalSRZoneBreakRetest", SWING))}
