"""Indicator columns on chunked series.

``Frame`` wraps a chunked bar table.  Asking it for a column name adds that column and whatever it depends on.
Fixed-frame indicators are window expressions over (key, chunk); all of them share one exchange and one sort.
Recursive ones (EMA family) come from one grouped pass per chunk that runs before the windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import recursive as rec
from barloom.series import KEYS, chunk_length, number_bars, own_rows, with_halo

BASE = ["symbol", "timeframe", "ts", "bar_no", "series_rows", "open", "high", "low", "close", "volume"]
WINDOW_SLACK = 700
C = F.col

# The default column set of a full feature table and its short names.
ALIASES = {
    "MACD": "MACD_12_26_9", "MACD_SIGNAL": "MACDSIG_12_26_9", "MACD_HIST": "MACDHIST_12_26_9",
    "STOCH_K": "STOCHK_14", "STOCH_D": "STOCHD_14_3", "ADX": "ADX_14", "PLUS_DI": "PLUSDI_14",
    "MINUS_DI": "MINUSDI_14", "CCI": "CCI_20", "WILLR": "WILLR_14", "KC_MID": "EMA_20",
    "KC_UPPER": "KCU_20_20_2.0", "KC_LOWER": "KCL_20_20_2.0", "HULL_MA": "HULL_20", "VOLATILITY": "STD_20",
    "BB_MID_20": "SMA_20", "BB_UPPER_20": "BBU_20_2.0", "BB_LOWER_20": "BBL_20_2.0",
}
ALL_FEATURES = (
    [f"ATR_{n}" for n in (7, 10, 14, 20)]
    + [f"{k}_{n}" for n in (5, 8, 10, 13, 20, 21, 30, 50, 100, 200) for k in ("SMA", "EMA")]
    + [f"RSI_{n}" for n in (7, 14, 21)]
    + ["BB_MID_20", "BB_UPPER_20", "BB_LOWER_20", "MACD", "MACD_SIGNAL", "MACD_HIST", "STOCH_K", "STOCH_D", "ADX",
       "PLUS_DI", "MINUS_DI", "CCI", "WILLR", "DONCHIAN_HIGH_20", "DONCHIAN_LOW_20", "DONCHIAN_HIGH_50",
       "DONCHIAN_LOW_50", "KC_MID", "KC_UPPER", "KC_LOWER", "HULL_MA", "CHANGE", "CHANGE_PCT", "VOLATILITY"]
)
# Recursive columns a window column is built on.
_NEEDS = [
    (re.compile(r"^KC[UL]_(\d+)_"), lambda m: [f"EMA_{m[1]}"]),
    (re.compile(r"^STOCHRSI[KD]?_(\d+)_"), lambda m: [f"RSI_{m[1]}"]),
]


def resolve(name: str) -> str:
    return ALIASES.get(name, name)


def recursive_needs(names: Iterable[str]) -> list[str]:
    found: dict[str, None] = {}
    for raw in names:
        name = resolve(raw)
        if rec.family(name):
            found[name] = None
        for pattern, deps in _NEEDS:
            m = pattern.match(name)
            if m:
                found.update(dict.fromkeys(deps(m)))
    return list(found)


class Frame:
    """A chunked series table that grows columns on demand."""

    def __init__(self, df: DataFrame, keys: Sequence[str] = KEYS):
        self._df = df
        self._known = set(df.columns)
        self._lazy: dict[str, tuple[Column, int]] = {}
        self.keys = list(keys)
        self.part = Window.partitionBy(*self.keys, "_chunk").orderBy("bar_no")

    @classmethod
    def of(cls, bars: DataFrame, recursive: Sequence[str] = (), lookback: int = WINDOW_SLACK,
           keys: Sequence[str] = KEYS, chunk_rows: int | None = None) -> Frame:
        """Number, chunk and halo the bars; run the recursive pass when recursive columns are asked for."""
        numbered = bars if "bar_no" in bars.columns else number_bars(bars, keys, chunk_rows)
        recursive = [resolve(n) for n in dict.fromkeys(recursive)]
        halo = lookback + max([rec.memory(n) for n in recursive], default=0)
        df = with_halo(numbered, halo, chunk_rows)
        if recursive:
            df = _recursive_pass(df, recursive, keys)
        f = cls(df, keys)
        f.halo, f.chunk_rows = halo, chunk_length(bars, chunk_rows)
        return f

    @property
    def df(self) -> DataFrame:
        """The table with every asked-for column; columns that do not build on each other share one projection."""
        for level in range(1 + max((lv for _, lv in self._lazy.values()), default=-1)):
            self._df = self._df.withColumns({n: c for n, (c, lv) in self._lazy.items() if lv == level})
        self._lazy = {}
        return self._df

    def has(self, name: str) -> bool:
        return name in self._known

    def put(self, **cols: Column) -> Frame:
        for n, c in cols.items():
            if not self.has(n):
                used = set(re.findall(r"[\w.~]+", str(c)))
                self._lazy[n] = (c, 1 + max((self._lazy[u][1] for u in used if u in self._lazy), default=-1))
                self._known.add(n)
        return self

    def own_name(self, name: str) -> str:
        """Name of a helper column of one rule; a frame scoped to a rule variant adds the variant."""
        return f"_{name}"

    def name(self, name: str, expr: Callable[[], Column] | Column) -> Column:
        if not self.has(name):
            self.put(**{name: expr() if callable(expr) else expr})
        return F.col(f"`{name}`")

    def rows(self, n: int, end: int = 0) -> Window:
        return self.part.rowsBetween(-(n - 1) + end, end)

    def lag(self, name: str, n: int = 1) -> Column:
        return self.name(f"{name}~{n}", lambda: F.lag(F.col(f"`{name}`"), n).over(self.part)) if n else C(f"`{name}`")

    def full(self, agg: Callable[[Column], Column], col: Column, n: int, end: int = 0) -> Column:
        """Aggregate of a frame that holds n non-null values, else null."""
        w = self.rows(n, end)
        return F.when(F.count(col).over(w) == n, agg(col).over(w))

    def ffill(self, out: str, name: str) -> Column:
        """Last non-null value up to each row, however far back.

        Inside a chunk it is a window; what lies before the halo comes from one carry row per chunk.
        """
        if not self.has(out):
            df = self.df
            seg = F.expr(f"(bar_no + {self.halo}) div {self.chunk_rows}")
            carry = df.filter("_own").groupBy(*self.keys, (seg + 1).alias("_chunk")).agg(
                F.max_by(F.col(f"`{name}`"), F.when(F.col(f"`{name}`").isNotNull(), F.col("bar_no"))).alias("_s"))
            chunks = df.select(*self.keys, "_chunk").distinct()
            wk = Window.partitionBy(*self.keys).orderBy("_chunk")
            carry = (chunks.join(carry, [*self.keys, "_chunk"], "left")
                     .select(*self.keys, "_chunk", F.last("_s", ignorenulls=True).over(wk).alias("_carry")))
            inner = F.last(F.col(f"`{name}`"), ignorenulls=True).over(self.part.rowsBetween(Window.unboundedPreceding, 0))
            self._df = df.join(carry, [*self.keys, "_chunk"], "left").withColumn("_in", inner).withColumn(
                out, F.coalesce("_in", "_carry")).drop("_in", "_carry")
            self._known.add(out)
        return F.col(f"`{out}`")

    def need(self, name: str) -> Column:
        """Column by feature name, added with its inputs when absent."""
        if self.has(name):
            return F.col(f"`{name}`")
        real = resolve(name)
        if real != name:
            return self.name(name, self.need(real))
        for pattern, build in _WINDOW_FEATURES:
            m = pattern.match(name)
            if m:
                build(self, *[_num(g) for g in m.groups()])
                return F.col(f"`{name}`")
        raise KeyError(f"unknown feature {name}")

    def own(self) -> DataFrame:
        return own_rows(self.df)


def _num(text: str) -> int | float | str:
    if text.isdigit():
        return int(text)
    return float(text) if text[0].isdigit() else text


def _recursive_pass(df: DataFrame, names: list[str], keys: Sequence[str]) -> DataFrame:
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T.DoubleType()) for n in names])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_no", ignore_index=True)
        return pd.concat([pdf, rec.compute(pdf, names)], axis=1)

    return df.groupBy(*keys, "_chunk").applyInPandas(run, schema)


# ---- window features -------------------------------------------------------------------------------------------------

def _tr(f: Frame) -> None:
    pc = f.lag("close")
    f.put(TR=F.greatest(C("high") - C("low"), F.abs(C("high") - pc), F.abs(C("low") - pc)))


def _atr(f: Frame, n: int) -> None:
    f.put(**{f"ATR_{n}": f.full(F.avg, f.need("TR"), n)})


def _sma(f: Frame, n: int) -> None:
    """Short frames are summed afresh; long ones are a difference of running sums, one step per row for any n.

    The running sum restarts with every chunk, which bounds its rounding.
    """
    if n < 30:
        f.put(**{f"SMA_{n}": f.full(F.avg, C("close"), n)})
        return
    run = f.part.rowsBetween(Window.unboundedPreceding, 0)
    f.put(_RSUM=F.sum("close").over(run), _RCNT=F.count("close").over(run))
    was = lambda c: F.coalesce(f.lag(c, n), F.lit(0))
    f.put(**{f"SMA_{n}": F.when(C("_RCNT") - was("_RCNT") == n, (C("_RSUM") - was("_RSUM")) / n)})


def _std(f: Frame, n: int) -> None:
    f.put(**{f"STD_{n}": f.full(F.stddev_samp, C("close"), n)})


def _bb(f: Frame, side: str, n: int, k: float) -> None:
    mid, sd = f.need(f"SMA_{n}"), f.need(f"STD_{n}")
    f.put(**{f"BB{side}_{n}_{k}": mid + k * sd if side == "U" else mid - k * sd})


def _hh(f: Frame, n: int) -> None:
    f.put(**{f"HH_{n}": f.full(F.max, C("high"), n)})


def _ll(f: Frame, n: int) -> None:
    f.put(**{f"LL_{n}": f.full(F.min, C("low"), n)})


def _donchian(f: Frame, side: str, n: int) -> None:
    f.put(**{f"DONCHIAN_{side}_{n}": f.need(f"{'HH' if side == 'HIGH' else 'LL'}_{n}")})


def _stochk(f: Frame, n: int) -> None:
    hi, lo = f.need(f"HH_{n}"), f.need(f"LL_{n}")
    f.put(**{f"STOCHK_{n}": 100 * (C("close") - lo) / F.nullif(hi - lo, F.lit(0.0))})


def _stochd(f: Frame, n: int, d: int) -> None:
    f.put(**{f"STOCHD_{n}_{d}": f.full(F.avg, f.need(f"STOCHK_{n}"), d)})


def _willr(f: Frame, n: int) -> None:
    hi, lo = f.need(f"HH_{n}"), f.need(f"LL_{n}")
    f.put(**{f"WILLR_{n}": -100 * (hi - C("close")) / F.nullif(hi - lo, F.lit(0.0))})


def _moves(f: Frame) -> None:
    f.put(UP=C("high") - f.lag("high"), DLOW=C("low") - f.lag("low"), DCLOSE=C("close") - f.lag("close"))


def _adx(f: Frame, n: int) -> None:
    """Simple-mean ADX: the down move counts by size whatever its sign, against the already filtered up move."""
    f.need("UP")
    atr = f.need(f"ATR_{n}") + 1e-10
    drop = F.abs(C("DLOW"))
    f.put(_PDM=F.when((C("UP") > drop) & (C("UP") > 0), C("UP")).otherwise(0.0))
    f.put(_MDM=F.when((drop > C("_PDM")) & (drop > 0), drop).otherwise(0.0))
    f.put(**{f"_PDIC_{n}": 100 * f.full(F.avg, C("_PDM"), n) / atr, f"_MDIC_{n}": 100 * f.full(F.avg, C("_MDM"), n) / atr})
    p, m = C(f"_PDIC_{n}"), C(f"_MDIC_{n}")
    f.put(**{f"_DXC_{n}": 100 * F.abs(p - m) / (p + m + 1e-10)})
    f.put(**{f"ADX_{n}": f.full(F.avg, C(f"_DXC_{n}"), n)})


def _plusdi(f: Frame, n: int) -> None:
    up = f.need("UP")
    f.put(_UPPOS=F.when(up > 0, up).otherwise(0.0))
    f.put(**{f"PLUSDI_{n}": 100 * (f.full(F.avg, C("_UPPOS"), n) / (f.need(f"ATR_{n}") + 1e-10))})


def _minusdi(f: Frame, n: int) -> None:
    f.need("UP")
    f.put(_DROP=F.abs(C("DLOW")))
    f.put(**{f"MINUSDI_{n}": 100 * (f.full(F.avg, C("_DROP"), n) / (f.need(f"ATR_{n}") + 1e-10))})


def _typical(f: Frame) -> None:
    f.put(TP=(C("high") + C("low") + C("close")) / 3)


def _mad(f: Frame, n: int) -> None:
    tp = f.need("TP")
    f.put(**{f"_TPS_{n}": F.collect_list(tp).over(f.rows(n)), f"_TPM_{n}": f.full(F.avg, tp, n)})
    total = F.aggregate(C(f"_TPS_{n}"), F.lit(0.0), lambda a, x: a + F.abs(x - C(f"_TPM_{n}")))
    f.put(**{f"MAD_{n}": F.when(C(f"_TPM_{n}").isNotNull(), total / n)})


def _cci(f: Frame, n: int) -> None:
    mad = f.need(f"MAD_{n}")
    f.put(**{f"CCI_{n}": (f.need("TP") - C(f"_TPM_{n}")) / (0.015 * F.nullif(mad, F.lit(0.0)))})


def _kc(f: Frame, side: str, e: int, a: int, k: float) -> None:
    mid, atr = f.need(f"EMA_{e}"), f.need(f"ATR_{a}")
    f.put(**{f"KC{side}_{e}_{a}_{k}": mid + k * atr if side == "U" else mid - k * atr})


def _wma(f: Frame, name: str, n: int) -> Column:
    terms = [f.lag(name, n - 1 - j) * (j + 1) for j in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / (n * (n + 1) / 2)


def _hull(f: Frame, n: int) -> None:
    half, root = max(1, n // 2), max(1, int(math.sqrt(n)))
    f.put(**{f"_WH_{n}": _wma(f, "close", half), f"_WF_{n}": _wma(f, "close", n)})
    f.put(**{f"_HRAW_{n}": 2 * C(f"_WH_{n}") - C(f"_WF_{n}")})
    f.put(**{f"HULL_{n}": _wma(f, f"_HRAW_{n}", root)})


def _change(f: Frame) -> None:
    prev = f.lag("close")
    f.put(CHANGE=C("close") - prev, CHANGE_PCT=(C("close") / F.nullif(prev, F.lit(0.0)) - 1) * 100)


def swing_marks(f: Frame, col: str, order: int) -> tuple[Column, Column]:
    """(high mark, low mark): the value ``order`` bars back is the extreme of 2*order+1; known without look-ahead."""
    w = f.rows(2 * order + 1)
    pivot = f.lag(col, order)
    ready = (C("bar_no") >= 2 * order) & pivot.isNotNull()
    hi = f.name(f"SWH_{col}_{order}", F.coalesce(ready & (pivot == F.max(C(f"`{col}`")).over(w)), F.lit(False)))
    lo = f.name(f"SWL_{col}_{order}", F.coalesce(ready & (pivot == F.min(C(f"`{col}`")).over(w)), F.lit(False)))
    return hi, lo


def _swing_price(f: Frame, side: str, order: int) -> None:
    """Pivot price on the bar that confirms it, else null."""
    src = "high" if side == "H" else "low"
    hi, lo = swing_marks(f, src, order)
    f.put(**{f"PIVOT{side}_{order}": F.when(hi if side == "H" else lo, f.lag(src, order))})


def _pctrank(f: Frame, col: str, n: int) -> None:
    x = f.need(col)
    f.put(**{f"_PRL_{col}_{n}": F.collect_list(x).over(f.rows(n))})
    below = F.size(F.filter(C(f"`_PRL_{col}_{n}`"), lambda v: v < x))
    f.put(**{f"PCTRANK_{col}_{n}": F.when(F.size(C(f"`_PRL_{col}_{n}`")) == n, below / (n - 1) * 100.0)})


def _roc(f: Frame, n: int) -> None:
    f.put(**{f"ROC_{n}": (C("close") / F.nullif(f.lag("close", n), F.lit(0.0)) - 1) * 100})


def _vortex(f: Frame, n: int) -> None:
    tr = f.need("TR")
    f.put(_VMP=F.abs(C("high") - f.lag("low")), _VMM=F.abs(C("low") - f.lag("high")))
    tot = f.full(F.sum, tr, n) + 1e-10
    f.put(**{f"VIP_{n}": f.full(F.sum, C("_VMP"), n) / tot, f"VIM_{n}": f.full(F.sum, C("_VMM"), n) / tot})


def _aroon(f: Frame, n: int) -> None:
    """First position of the extreme within n+1 bars."""
    w = f.rows(n + 1)
    ready = C("bar_no") >= n
    f.put(**{f"_ARH_{n}": F.collect_list("high").over(w), f"_ARL_{n}": F.collect_list("low").over(w)})
    up = F.array_position(C(f"_ARH_{n}"), F.array_max(C(f"_ARH_{n}"))) - 1
    dn = F.array_position(C(f"_ARL_{n}"), F.array_min(C(f"_ARL_{n}"))) - 1
    f.put(**{f"AROONU_{n}": F.when(ready, 100.0 * up / n), f"AROOND_{n}": F.when(ready, 100.0 * dn / n)})


def _vwap(f: Frame, n: int) -> None:
    tp, vol = f.need("TP"), F.coalesce(C("volume"), F.lit(1.0))
    f.put(**{f"VWAP_{n}": f.full(F.sum, tp * vol, n) / (f.full(F.sum, vol, n) + 1e-10)})


def _vwapz(f: Frame, n: int, z: int) -> None:
    vwap = f.need(f"VWAP_{n}")
    f.put(**{f"_VDEV_{n}": C("close") - vwap})
    dev = C(f"_VDEV_{n}")
    f.put(**{f"VWAPZ_{n}_{z}": (dev - f.full(F.avg, dev, z)) / (f.full(F.stddev_samp, dev, z) + 1e-10)})


def _stochrsi(f: Frame, r: int, s: int, k: int, d: int) -> None:
    x = f.need(f"RSI_{r}")
    key = f"{r}_{s}_{k}_{d}"
    f.put(**{f"_SRL_{key}": f.full(F.min, x, s), f"_SRH_{key}": f.full(F.max, x, s)})
    span = C(f"_SRH_{key}") - C(f"_SRL_{key}")
    f.put(**{f"_SR_{key}": F.when(span > 1e-8, 100 * (x - C(f"_SRL_{key}")) / span).otherwise(50.0)})
    f.put(**{f"STOCHRSIK_{key}": f.full(F.avg, C(f"_SR_{key}"), k)})
    f.put(**{f"STOCHRSID_{key}": f.full(F.avg, C(f"STOCHRSIK_{key}"), d)})


def _ichimoku(f: Frame, t: int, k: int, b: int) -> None:
    mid = lambda n: (f.need(f"HH_{n}") + f.need(f"LL_{n}")) / 2
    key = f"{t}_{k}_{b}"
    f.put(**{f"TENKAN_{key}": mid(t), f"KIJUN_{key}": mid(k), f"_SPANB_{key}": mid(b)})
    f.put(**{f"_SPANA_{key}": (C(f"TENKAN_{key}") + C(f"KIJUN_{key}")) / 2})
    f.put(**{f"SENKOUA_{key}": f.lag(f"_SPANA_{key}", k), f"SENKOUB_{key}": f.lag(f"_SPANB_{key}", k)})


def _zscore(f: Frame, n: int) -> None:
    f.put(**{f"ZSCORE_{n}": (C("close") - f.need(f"SMA_{n}")) / (f.need(f"STD_{n}") + 1e-10)})


def _signed_volume(f: Frame) -> None:
    f.need("DCLOSE")
    f.put(SVOL=F.coalesce(C("volume"), F.lit(0.0)) * F.coalesce(F.signum(C("DCLOSE")), F.lit(0.0)))


_WINDOW_FEATURES = [(re.compile(p), fn) for p, fn in [
    (r"^TR$", _tr), (r"^ATR_(\d+)$", _atr), (r"^SMA_(\d+)$", _sma), (r"^STD_(\d+)$", _std),
    (r"^HH_(\d+)$", _hh), (r"^LL_(\d+)$", _ll), (r"^STOCHK_(\d+)$", _stochk), (r"^STOCHD_(\d+)_(\d+)$", _stochd),
    (r"^BBU_(\d+)_([\d.]+)$", lambda f, n, k: _bb(f, "U", n, k)),
    (r"^BBL_(\d+)_([\d.]+)$", lambda f, n, k: _bb(f, "L", n, k)),
    (r"^DONCHIAN_HIGH_(\d+)$", lambda f, n: _donchian(f, "HIGH", n)),
    (r"^DONCHIAN_LOW_(\d+)$", lambda f, n: _donchian(f, "LOW", n)),
    (r"^WILLR_(\d+)$", _willr), (r"^(?:UP|DLOW|DCLOSE)$", _moves), (r"^ADX_(\d+)$", _adx),
    (r"^PLUSDI_(\d+)$", _plusdi), (r"^MINUSDI_(\d+)$", _minusdi), (r"^TP$", _typical), (r"^MAD_(\d+)$", _mad),
    (r"^CCI_(\d+)$", _cci), (r"^HULL_(\d+)$", _hull), (r"^CHANGE(?:_PCT)?$", _change),
    (r"^KCU_(\d+)_(\d+)_([\d.]+)$", lambda f, e, a, k: _kc(f, "U", e, a, k)),
    (r"^KCL_(\d+)_(\d+)_([\d.]+)$", lambda f, e, a, k: _kc(f, "L", e, a, k)),
    (r"^PIVOTH_(\d+)$", lambda f, n: _swing_price(f, "H", n)),
    (r"^PIVOTL_(\d+)$", lambda f, n: _swing_price(f, "L", n)),
    (r"^ROC_(\d+)$", _roc), (r"^VI[PM]_(\d+)$", _vortex), (r"^AROON[UD]_(\d+)$", _aroon),
    (r"^VWAP_(\d+)$", _vwap), (r"^VWAPZ_(\d+)_(\d+)$", _vwapz), (r"^ZSCORE_(\d+)$", _zscore),
    (r"^STOCHRSI[KD]_(\d+)_(\d+)_(\d+)_(\d+)$", _stochrsi), (r"^SVOL$", _signed_volume),
    (r"^(?:TENKAN|KIJUN|SENKOUA|SENKOUB)_(\d+)_(\d+)_(\d+)$", _ichimoku),
    (r"^PCTRANK_((?:ATR|ROC)_\d+)_(\d+)$", _pctrank),
]]


def features(bars: DataFrame, names: Sequence[str] | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Bars plus the named feature columns (all default ones when not given)."""
    names = list(ALL_FEATURES if names is None else names)
    f = Frame.of(bars, recursive_needs(names), lookback=lookback(names), chunk_rows=chunk_rows)
    for n in names:
        f.need(n)
    return f.own().select(*[c for c in BASE if c in f.df.columns], *[f"`{n}`" for n in names])


def lookback(names: Iterable[str]) -> int:
    """Bars of context that covers nested fixed frames of the named columns."""
    digits = [sum(int(d) for d in re.findall(r"_(\d+)(?![.\d])", resolve(n))) for n in names]
    return WINDOW_SLACK + 3 * max(digits, default=0)
