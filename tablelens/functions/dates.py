"""Dates in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"( \d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?"
_CLOCK_FORM = "[ H:mm[:ss[.SSSSSSSSS]]]"
#: Accepted forms of dates, each with the form of a text that may be one, so that no parser sees others.
#: Of a day and a month in numbers before the year, the month comes first if it can.
DATE_FORMS = (
    ("yyyy-M-d" + _CLOCK_FORM, rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}{_CLOCK}$"),
    ("yyyy/M/d" + _CLOCK_FORM, rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_CLOCK}$"),
    ("M/d/yyyy" + _CLOCK_FORM, rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$"),
    ("d/M/yyyy" + _CLOCK_FORM, rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_CLOCK}$"),
    ("M-d-yyyy" + _CLOCK_FORM, rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}{_CLOCK}$"),
    ("d-M-yyyy" + _CLOCK_FORM, rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}{_CLOCK}$"),
    ("M.d.yyyy" + _CLOCK_FORM, rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_CLOCK}$"),
    ("d.M.yyyy" + _CLOCK_FORM, rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_CLOCK}$"),
    ("d MMM yyyy" + _CLOCK_FORM, rf"^\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}}{_CLOCK}$"),
    ("d MMMM yyyy" + _CLOCK_FORM, rf"^\d{{1,2}} [A-Z][a-z]{{2,8}} \d{{4}}{_CLOCK}$"),
    ("MMM d yyyy" + _CLOCK_FORM, rf"^[A-Z][a-z]{{2}} \d{{1,2}} \d{{4}}{_CLOCK}$"),
    ("MMMM d yyyy" + _CLOCK_FORM, rf"^[A-Z][a-z]{{2,8}} \d{{1,2}} \d{{4}}{_CLOCK}$"),
    ("yyyyMMdd", r"^(1[6-9]|2[0-2])\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"),
    ("yyyy-MM", r"^\d{4}-\d{2}$"),
    ("yyyy", r"^(1[7-9]|2[0-1])\d{2}$"),
)
#: Times with a T or a zone; they become times of the session's zone.
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?$"


#: What all forms have in common: few characters, and a number or the name of a month in front. Other texts are tried once.
_MAY_BE = r"(?s)^(?=.{4,45}$)(\d{1,4}[-/. ].*|[A-Za-z]{3,9} \d{1,2}.*|\d{8}|\d{4})$"


def parsed_time(c: Column) -> Column:
    """A text as a timestamp, null if it has none of the accepted forms."""
    text = F.trim(c)
    iso = F.regexp_replace(text, r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    zoned = F.when(text.rlike(_ISO), iso.try_cast("timestamp"))
    named = F.initcap(F.regexp_replace(F.regexp_replace(text, r"(?i)^(\d{1,2})-([a-z]{3,9})-(\d{4})", "$1 $2 $3"), ",", ""))  # 5-JAN-2024, Jan 5, 2024
    plain = lambda form: named if "MMM" in form else text
    forms = [F.when(plain(pattern).rlike(form), F.try_to_timestamp(plain(pattern), F.lit(pattern))) for pattern, form in DATE_FORMS]
    return F.when(text.rlike(_MAY_BE) & text.rlike(r"\d{4}"), F.coalesce(*forms, zoned)).cast("timestamp_ntz")
