"""Sessions of the New York Stock Exchange by rule, from 1990 on."""

from __future__ import annotations

import datetime as dt

FIRST = 1990
#: Closures that follow no rule.
CLOSED = ("1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def easter(year: int) -> dt.date:
    """Western Easter Sunday (Gauss's rule, in its anonymous Gregorian form)."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month; the last for n = -1."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


def observed(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def holidays(year: int) -> set[dt.date]:
    new_year = dt.date(year, 1, 1)
    out = {new_year if new_year.weekday() != 6 else dt.date(year, 1, 2)}  # not moved back into the old year
    out |= {nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), nth(year, 5, 0, -1), observed(dt.date(year, 7, 4)), nth(year, 9, 0, 1), nth(year, 11, 3, 4), observed(dt.date(year, 12, 25))}
    if year >= 1998:
        out.add(nth(year, 1, 0, 3))
    if year >= 2022:
        out.add(observed(dt.date(year, 6, 19)))
    return out | {d for d in map(dt.date.fromisoformat, CLOSED) if d.year == year}


def sessions(first: dt.date, last: dt.date) -> list[dt.date]:
    if first.year < FIRST:
        raise ValueError(f"the rules hold from {FIRST} on, not for {first}; give earlier sessions as a table")
    closed = {d for y in range(first.year, last.year + 1) for d in holidays(y)}
    days = (first + dt.timedelta(k) for k in range((last - first).days + 1))
    return [d for d in days if d.weekday() < 5 and d not in closed]
