"""How the other lines of a text support each of its lines (TXT-20), in one pass over the text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: (length, distance) of the windows of a line, as in ``text.verification_status``.
WIDE, NARROW = (20, 10), (8, 8)


def _places(whole: str, lines: list[str], size: int, step: int) -> dict[str, tuple[int, int]]:
    """First and last start in the whole text of every window of a line."""
    wanted = {line[k : k + size] for line in lines for k in range(0, len(line) - size + 1, step)}
    places: dict[str, tuple[int, int]] = {}
    if wanted:
        for at in [j for j in range(len(whole) - size + 1) if whole[j : j + size] in wanted]:
            window = whole[at : at + size]
            places[window] = (places.get(window, (at,))[0], at)
    return places


def line_status(lines: list[str]) -> list[str]:
    """``text.verification_status`` of every line (compact) against all other lines put together.

    A line's other text is what stands before and behind it, and what meets where it is taken out.  Windows are looked up by
    their first and last place in the whole text, found once, so the work does not grow with lines times length.
    """
    whole = "".join(lines)
    wide, narrow = _places(whole, lines, *WIDE), _places(whole, lines, *NARROW)
    found, start = [], 0
    for line in lines:
        end = start + len(line)

        def elsewhere(part: str, first: int, last: int) -> bool:
            size = len(part)
            return first + size <= start or last >= end or part in whole[max(0, start - size + 1) : start] + whole[end : end + size - 1]

        def held(part: str) -> bool:
            size, head = len(part), part[: NARROW[0]]
            if size >= NARROW[0] and not elsewhere(head, *narrow[head]):
                return False  # its first window stands nowhere else
            return elsewhere(part, whole.find(part), whole.rfind(part))

        def windows(places: dict[str, tuple[int, int]], size: int, step: int):
            cuts = (line[k : k + size] for k in range(0, len(line) - size + 1, step))
            return (True for cut in cuts if elsewhere(cut, *places[cut]))

        if not line:
            status = "empty"
        elif held(line):
            status = "exact"
        elif len(line) >= 16 and held(line[:40]) or any(windows(wide, *WIDE)):
            status = "partial"
        elif sum(windows(narrow, *NARROW)) >= 2:
            status = "concept_supported"
        else:
            status = "unverified"
        found.append(status)
        start = end
    return found


@F.pandas_udf(ArrayType(StringType()))
def _statuses(lines: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else line_status(list(x)) for x in lines], dtype=object)


def lines_status(lines: Column) -> Column:
    """``line_status`` of an array of compact lines."""
    return _statuses(lines)


__all__ = ["line_status", "lines_status"]
