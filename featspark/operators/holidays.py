"""Public holidays from rules, as a small calendar table."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "_day date, is_holiday boolean, days_to_holiday int, days_since_holiday int, is_bridge_day boolean"


def easter(year: int) -> date:
    """Gregorian Easter Sunday (Gauss's rule with its two exceptions)."""
    century = year // 100
    moon = (15 - (13 + 8 * century) // 25 + century - century // 4) % 30
    sun = (4 + century - century // 4) % 7
    d = (19 * (year % 19) + moon) % 30
    e = (2 * (year % 4) + 4 * (year % 7) + 6 * d + sun) % 7
    if d == 29 and e == 6:
        e = -1
    elif d == 28 and e == 6 and (11 * moon + 11) % 30 < 19:
        e = -1
    return date(year, 3, 22) + timedelta(days=d + e)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """The nth weekday (Monday 0) of a month; from its end if n is negative."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7 + 7 * (-n - 1))


def observed(day: date) -> set[date]:
    """A fixed day, and the Friday before or Monday after if it falls on a weekend."""
    shift = {5: -1, 6: 1}.get(day.weekday(), 0)
    return {day, day + timedelta(days=shift)}


def us_holidays(year: int) -> set[date]:
    days = {nth_weekday(year, 1, 0, 3), nth_weekday(year, 2, 0, 3), nth_weekday(year, 5, 0, -1), nth_weekday(year, 9, 0, 1),
            nth_weekday(year, 10, 0, 2), nth_weekday(year, 11, 3, 4)}
    for month, day, since in ((1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)):
        if year >= since:
            days |= observed(date(year, month, day))
    return days


#: German states' own holidays, as days from Easter or (month, day).
GERMAN_STATES = {
    "BW": [(1, 6), 60, (11, 1)], "BY": [(1, 6), 60, (8, 15), (11, 1)], "BE": [(3, 8)], "BB": [0, 49, (10, 31)], "HB": [(10, 31)], "HH": [(10, 31)],
    "HE": [60], "MV": [(3, 8), (10, 31)], "NI": [(10, 31)], "NW": [60, (11, 1)], "RP": [60, (11, 1)], "SL": [60, (8, 15), (11, 1)],
    "SN": [(10, 31), "repentance"], "ST": [(1, 6), (10, 31)], "SH": [(10, 31)], "TH": [(9, 20), (10, 31)],
}


def german_holidays(year: int, state: str | None) -> set[date]:
    if state is not None and state not in GERMAN_STATES:
        raise ValueError(f"unknown subdivision {state!r}")
    start = easter(year)
    days = {date(year, *d) for d in ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26))} | {start + timedelta(days=k) for k in (-2, 1, 39, 50)}
    for rule in GERMAN_STATES.get(state or "", []):
        if rule == "repentance":
            november = date(year, 11, 22)
            days.add(november - timedelta(days=(november.weekday() - 2) % 7))
        else:
            days.add(start + timedelta(days=rule) if isinstance(rule, int) else date(year, *rule))
    return days


#: National holidays as days from Easter or (month, day).
NATIONAL = {
    "AT": [(1, 1), (1, 6), 1, (5, 1), 39, 50, 60, (8, 15), (10, 26), (11, 1), (12, 8), (12, 25), (12, 26)],
    "BE": [(1, 1), 0, 1, (5, 1), 39, 49, 50, (7, 21), (8, 15), (11, 1), (11, 11), (12, 25)],
    "ES": [(1, 1), (1, 6), -2, (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)],
    "FR": [(1, 1), 1, (5, 1), (5, 8), 39, 50, (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)],
    "IT": [(1, 1), (1, 6), 0, 1, (4, 25), (5, 1), (6, 2), (8, 15), (11, 1), (12, 8), (12, 25), (12, 26)],
    "PL": [(1, 1), (1, 6), 0, 1, (5, 1), (5, 3), 49, 60, (8, 15), (11, 1), (11, 11), (12, 25), (12, 26)],
    "PT": [(1, 1), -2, 0, (4, 25), (5, 1), 60, (6, 10), (8, 15), (10, 5), (11, 1), (12, 1), (12, 8), (12, 25)],
}


def english_holidays(year: int) -> set[date]:
    """Bank holidays of England by rule, with their substitutes; single ones are not known here."""
    days = {easter(year) + timedelta(days=k) for k in (-2, 1)} | {nth_weekday(year, 5, 0, 1), nth_weekday(year, 5, 0, -1), nth_weekday(year, 8, 0, -1)}
    fixed = [date(year, 1, 1), date(year, 12, 25), date(year, 12, 26)]
    days.update(fixed)
    for day in (d for d in fixed if d.weekday() >= 5):
        while day.weekday() >= 5 or day in days:
            day += timedelta(days=1)
        days.add(day)
    return days


def holidays_of(country: str, years: Iterable[int], subdiv: str | None = None) -> set[date]:
    """Holidays of a country (US, DE with states, GB, those of ``NATIONAL``) in some years; unknown
    countries and subdivisions are a ``ValueError``."""
    if subdiv is not None and country != "DE":
        raise ValueError(f"no subdivisions of country {country!r}; give dates")
    rules = {"US": us_holidays, "DE": lambda y: german_holidays(y, subdiv), "GB": english_holidays}
    if country in NATIONAL:
        rules[country] = lambda y: {easter(y) + timedelta(days=r) if isinstance(r, int) else date(y, *r) for r in NATIONAL[country]}
    if country not in rules:
        raise ValueError(f"no holidays for country {country!r}; give dates")
    return set().union(*(rules[country](y) for y in years))


def holiday_calendar(spark: SparkSession, first: int | None, last: int | None, country: str, subdiv: str | None = None, dates: Iterable[date] | None = None) -> DataFrame:
    """A row a day of the years, with the distances to the holidays around it."""
    if first is None:
        holidays_of(country, [], subdiv) if dates is None else None
        return spark.createDataFrame([], SCHEMA)
    days = set(dates) if dates is not None else holidays_of(country, range(first - 1, last + 2), subdiv)
    off = lambda d: d in days or d.weekday() >= 5
    start, stop, one = date(first - 1, 1, 1), date(last + 1, 12, 31), timedelta(days=1)
    span = [start + timedelta(days=i) for i in range((stop - start).days + 1)]
    since, to, seen = {}, {}, None
    for d in span:
        seen = d if d in days else seen
        since[d] = (d - seen).days if seen else None
    seen = None
    for d in reversed(span):
        seen = d if d in days else seen
        to[d] = (seen - d).days if seen else None
    rows = [(d, d in days, to[d], since[d], not off(d) and off(d - one) and off(d + one)) for d in span if first <= d.year <= last]
    return spark.createDataFrame(rows, SCHEMA)
