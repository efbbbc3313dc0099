"""Parameters of the library with their defaults and bounds."""

from __future__ import annotations

import dataclasses
import math


@dataclasses.dataclass(frozen=True)
class Bound:
    """A number's default and range; whole: fractions are cut off; zero_is_off: 0 stays 0, whatever the range."""

    default: float
    low: float
    high: float
    whole: bool = False
    zero_is_off: bool = False

    def take(self, raw) -> float:
        """raw within the bounds; the default if it is no finite number."""
        if isinstance(raw, bool) or not isinstance(raw, (int, float)) or not math.isfinite(raw):
            return self.default
        value = math.trunc(raw) if self.whole else raw
        if self.zero_is_off and value <= 0:
            return 0
        return min(self.high, max(self.low, value))


# Defaults and bounds.
BOUNDS = {
    "alarm_radius_m": Bound(500, 1, 100_000),
    "corridor_half_width_m": Bound(500, 1, 50_000),
    "dedupe_radius_m": Bound(45.72, 1, 10_000),
    "clearance_margin_m": Bound(1, 0, 30),
    "minimum_rating": Bound(0, 0, 5),
    "minimum_year": Bound(0, 1900, 9999, whole=True, zero_is_off=True),
    "refresh_hours": Bound(24, 1, 168),
}


def normalised(raw: dict) -> dict[str, float]:
    """All parameters, within their bounds; unknown names are dropped."""
    return {name: bound.take(raw.get(name)) for name, bound in BOUNDS.items()}
