"""Date and year filters: short texts, parsed on the driver into column conditions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_day(text: str) -> date:
    """The first day of YYYY, YYYY-MM or YYYY-MM-DD; ValueError for others."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", text.strip())
    if not m:
        raise ValueError(f"no date: {text!r}")
    return date(int(m[1]), int(m[2] or 1), int(m[3] or 1))


def day_after(text: str) -> date:
    """The first day behind the period that the text names."""
    start = first_day(text)
    parts = text.strip().count("-")
    if parts == 2:
        return start + timedelta(days=1)
    if parts == 1:
        return date(start.year + start.month // 12, start.month % 12 + 1, 1)
    return date(start.year + 1, 1, 1)


@dataclass(frozen=True)
class DateFilter:
    """Half open: after <= day < before."""

    after: date | None = None
    before: date | None = None

    @staticmethod
    def parse(text: str) -> DateFilter:
        """Tokens like '>=2020 <2024-06': at most one bound on each side; ValueError otherwise.

        '>' and '<=' reach over the whole period, so '>2020' starts with 2021.
        """
        after = before = None
        tokens = re.findall(r"(>=|<=|>|<)\s*([^\s<>]+)", text)
        if not tokens or re.sub(r"(>=|<=|>|<)\s*[^\s<>]+|[\s,]+", "", text):
            raise ValueError(f"no date filter: {text!r}")
        for op, value in tokens:
            if op[0] == ">":
                if after is not None:
                    raise ValueError("two lower bounds")
                after = first_day(value) if op == ">=" else day_after(value)
            else:
                if before is not None:
                    raise ValueError("two upper bounds")
                before = first_day(value) if op == "<" else day_after(value)
        if after is not None and before is not None and after >= before:
            raise ValueError("the range is empty")
        return DateFilter(after, before)

    def condition(self, day: Column | str) -> Column:
        """True for days inside; a null day is outside any bound."""
        day = F.col(day) if isinstance(day, str) else day
        out = F.lit(True)
        if self.after is not None:
            out = out & (day >= F.lit(self.after))
        if self.before is not None:
            out = out & (day < F.lit(self.before))
        return out


def year_condition(text: str, year: Column | str) -> Column | None:
    """'>=2020', '>2020', '<=2020', '<2020' or '2020' on an integer column; None if the text is none of them."""
    m = re.fullmatch(r"\s*(>=|<=|>|<)?\s*([+-]?\d+)\s*", text)
    if not m:
        return None
    y, n = (F.col(year) if isinstance(year, str) else year), int(m[2])
    return {">=": y >= n, ">": y > n, "<=": y <= n, "<": y < n, None: y == n}[m[1]]
