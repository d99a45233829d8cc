"""Durations such as ``1mo``, ``2w3d`` or ``30m``: parsing, approximate seconds, interval columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units in calendar order, months or microseconds of each, and seconds for comparisons.
MONTHS = {"y": 12, "q": 3, "mo": 1}
MICROS = {"w": 604_800_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000}
SECONDS = {"y": 31_557_600.0, "q": 7_889_400.0, "mo": 2_629_800.0, "w": 604_800.0, "d": 86_400.0, "h": 3600.0, "m": 60.0, "s": 1.0}
_WHOLE = re.compile(r"(?:[0-9]+(?:mo|y|q|w|d|h|m|s))+")
_PART = re.compile(r"([0-9]+)(mo|y|q|w|d|h|m|s)")


@dataclass(frozen=True)
class Duration:
    """Calendar months and fixed microseconds."""

    months: int
    micros: int
    seconds: float

    @property
    def fixed(self) -> bool:
        """No calendar part."""
        return self.months == 0

    def interval(self) -> Column:
        """An interval to add to or take from a timestamp; months clamp at the month's end."""
        return F.make_interval(months=F.lit(self.months), secs=F.lit(self.micros / 1e6))


def parse_duration(text: str) -> Duration:
    """The duration that ``text`` spells; anything else is a ``ValueError``."""
    if not isinstance(text, str) or not _WHOLE.fullmatch(text):
        raise ValueError(f"{text!r} is not a duration like '1mo', '2w3d' or '30m'")
    parts = [(int(n), unit) for n, unit in _PART.findall(text)]
    return Duration(sum(n * MONTHS.get(u, 0) for n, u in parts), sum(n * MICROS.get(u, 0) for n, u in parts), sum(n * SECONDS[u] for n, u in parts))


def approx_seconds(text: str) -> float:
    """Seconds of a duration, a year taken as 365.25 days."""
    return parse_duration(text).seconds
