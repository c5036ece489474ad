"""Bar frequency arithmetic: every window length in the package comes from a BarSpec."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Minutes of a timeframe's unit, and names without a count or with a unit of their own.
UNIT_MINUTES = {"min": 1, "t": 1, "h": 60, "d": 1440, "b": 1440, "w": 10080}
ALIASES = {"w-mon": "1w", "1w-mon": "1w"}
DEFAULT_MINUTES = 5


def timeframe_minutes(timeframe: str) -> int:
    """Minutes of a timeframe such as ``5min``, ``4h`` or ``w-mon``; unknown names mean 5.

    A count of units whose name is unknown counts minutes, as in ``10x``.
    """
    name = ALIASES.get(timeframe.lower().strip(), timeframe.lower().strip())
    count, unit = re.fullmatch(r"(\d*)([a-z]*).*", name, re.S).groups()
    if not count:
        return UNIT_MINUTES[unit] if name in ("d", "w") else DEFAULT_MINUTES
    return int(count) * UNIT_MINUTES.get(unit, 1) if unit else DEFAULT_MINUTES


def is_five_minute(timeframe: str) -> bool:
    return timeframe.lower().strip() in ("5min", "5t", "5m")


@dataclass(frozen=True)
class BarSpec:
    """Bars per hour and per day, and the horizons that follow from them."""

    bars_per_hour: int = 12
    bars_per_day: int = 288
    minutes: int = field(default=5, compare=False)

    @classmethod
    def from_timeframe(cls, timeframe: str) -> "BarSpec":
        minutes = max(timeframe_minutes(timeframe), 1)
        return cls(max(1, 60 // minutes), max(1, 1440 // minutes), minutes)

    @property
    def four_hour_bars(self) -> int:
        """Bars of the four-hour horizon, at least one."""
        return max(1, 240 // self.minutes)

    def horizon(self, minutes: int) -> int:
        """Bars of a horizon given in minutes, at least one."""
        return max(1, round(minutes * self.bars_per_hour / 60))

    @property
    def horizons(self) -> dict[str, int]:
        """Forward-return column name -> bars ahead."""
        return {
            "future_ret_15m": self.horizon(15),
            "future_ret_1h": self.horizon(60),
            "future_ret_1d": self.bars_per_day,
            "future_ret_5d": 5 * self.bars_per_day,
        }

    @property
    def feature_lookback(self) -> int:
        """Rows before a bar that the deepest feature chain reads (rank of a day-long deviation)."""
        return 6 * self.bars_per_day + 4 * self.bars_per_hour + 64


# Fixed horizons of the engine-side target builder, in 5-minute bars.
ENGINE_HORIZONS = {
    "future_ret_15m": 3, "future_ret_1h": 12, "future_ret_1d": 288, "future_ret_5d": 1440,
}


def target_plan(choice: str, columns: list[str], spec: BarSpec = BarSpec()) -> dict:
    """Target column, horizon and cross-validation gap for ``1h``, ``1d`` or ``5d``.

    Falls back to the plain ``future_ret`` column when the chosen one is absent.
    """
    name = f"future_ret_{choice}"
    bars = spec.horizons[name]
    column = name if name in columns else "future_ret"
    return {"column": column, "horizon": bars, "cv_gap": bars}
