"""Names of columns and tables, and what they suggest."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Sequence

# Name patterns of the data model, searched anywhere in a name and regardless of case.
ID_NAME = r"(^|_)(id|uuid|guid|key|code|no|number|sk|pk)$"
CURRENCY_NAME = r"price|cost|revenue|amount|sales|total|salary|spend|profit|margin|fee|usd|eur|inr|gbp"
TIME_NAME = r"date|time|timestamp|_at$|_on$|month|year|quarter|week|day"
GEO_NAME = r"country|region|state|city|province|zip|postal|lat|lon|lng|geo"
RATE_NAME = r"price|rate|ratio|pct|percent|share|score|avg|average|mean|days|age|index|level"
NOT_ADDED_UP = r"pct|percent|rate|ratio|price|score|days|avg|average"


def suggests(pattern: str, name: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None


def clean_alias(name: str, limit: int = 63) -> str:
    """Lower case, anything but letters, digits and _ as _, no leading digit, never empty."""
    out = re.sub(r"\W+", "_", name.strip()).strip("_").lower()[:limit]
    return ("c_" + out)[:limit] if out[:1].isdigit() else out or "value"


def table_name(*parts: str, limit: int = 63) -> str:
    out = re.sub(r"\W+", "_", "_".join(p for p in parts if p)).strip("_").lower()
    return (("t_" + out) if out[:1].isdigit() else out or "dataset")[:limit]


def normal_columns(names: Sequence[str | None]) -> list[str]:
    """Tidy, distinct column names in the same order.

    A name is its runs of letters and digits in lower case, joined by _. What is blank, of signs only, or 'unnamed: n' is
    named after its place, column_1 the first. A name that begins with a digit gets c_ in front, and one that is taken
    already gets the first free number behind.
    """
    out: dict[str, None] = {}
    for place, raw in enumerate(names, 1):
        runs = re.findall(r"[0-9a-z]+", (raw or "").lower())
        if not runs or re.fullmatch(r"unnamed:?\s*\d*", " ".join((raw or "").lower().split())):
            runs = ["column", str(place)]
        if runs[0][0].isdigit():
            runs.insert(0, "c")
        name = "_".join(runs)
        out[next(n for n in [name, *(f"{name}_{k}" for k in range(1, len(names) + 1))] if n not in out)] = None
    return list(out)


class UnknownName(ValueError):
    """A name that isn't there, with near ones."""


def resolve(name: str, known: Iterable[str], synonyms: dict[str, Sequence[str]] | None = None) -> str:
    """The known name that `name` means: same but for case, then with spaces as _, then by synonym."""
    known = list(known)
    lower = {k.lower(): k for k in reversed(known)}
    for form in (name.lower(), re.sub(r"\s+", "_", name.strip().lower())):
        if form in lower:
            return lower[form]
    for column, others in (synonyms or {}).items():
        if column in known and name.strip().lower() in {o.lower() for o in others}:
            return column
    near = difflib.get_close_matches(name.lower(), list(lower), n=3, cutoff=0.4)
    raise UnknownName(f"no column or table {name!r}" + (f"; did you mean {', '.join(lower[n] for n in near)}?" if near else ""))
