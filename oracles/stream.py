"""Reference SQL of the replayed streams: the batch results."""

from __future__ import annotations

from oracles.common import event_bars, r
from oracles.ledger import followed
from oracles.series import ORACLES as SERIES

ORACLES = {
    "stream_bars": f"SELECT symbol, ts, open, high, low, close, volume FROM ({event_bars('H1')})",
    "stream_regimes": SERIES["regime_hysteresis"].replace("CASE WHEN s.n < 210 THEN 'CHOP' ELSE z.live END", "z.live"),
    "stream_exits": f"""WITH {followed()} SELECT symbol, trade_id, trade_id + bars_held AS bar_no, exit_reason, {r('exit_price', 4)} AS exit_price
      FROM left_ WHERE exit_reason <> 'end_of_data'""",
}
