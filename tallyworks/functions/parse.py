"""Dates, money, dimensions and paths out of free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PLACEHOLDERS = ["", "NA", "N/A", "NONE", "TBD", "TBA", "-"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _group(s: Column, regex: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(s, regex, i), F.lit(""))


def _date(y: Column, m: Column, d: Column) -> Column:
    """The date, null if there is none such."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def loose_date(raw: Column, as_of_year: int) -> Column:
    """Date of a free text: ISO, month/day with or without a year, or a month's name; placeholders and impossible dates are null.

    A missing year is ``as_of_year``; years of two digits are of this century.
    """
    s = F.trim(raw)
    iso, us, name = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$", r"^([A-Za-z]+)\s+(\d{1,2})(?:[\s,]+(\d{4}))?$"
    part = lambda r, i: _group(s, r, i).cast("int")
    year = F.coalesce(part(us, 3), F.lit(as_of_year))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(_group(s, name, 1), 1, 3))).cast("int"), F.lit(0))
    out = F.when(s.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3)))
    out = out.when(s.rlike(us), _date(F.when(year < 100, year + 2000).otherwise(year), part(us, 1), part(us, 2)))
    out = out.when(s.rlike(name), _date(F.coalesce(part(name, 3), F.lit(as_of_year)), month, part(name, 2)))
    return F.when(~F.upper(s).isin(PLACEHOLDERS), out)


def money(raw: Column, strict: bool = False) -> Column:
    """Decimal of a money text.  The strict form drops only ``$`` and ``,``; the other also ``%``, a ``/UNIT`` ending, and reads ``(x)`` as minus x."""
    s = F.trim(raw)
    if strict:
        return F.translate(s, "$, \t\n\x0b\f\r", "").try_cast("decimal(18,4)")
    s = F.regexp_replace(s, r"/\s*[A-Za-z]+\.?$", "")
    s = F.regexp_replace(s, r"[$,%\s]", "")
    return F.regexp_replace(s, r"^\((.*)\)$", "-$1").try_cast("decimal(18,4)")


def feet(raw: Column) -> Column:
    """Feet of ``45'-6"``, ``45.5'``, ``18"`` or a bare number."""
    s = F.trim(raw)
    both, foot, inch, bare = r"^(\d+(?:\.\d+)?)'\s*-?\s*(\d+(?:\.\d+)?)\"?$", r"^(\d+(?:\.\d+)?)'$", r"^(\d+(?:\.\d+)?)\"$", r"^(\d+(?:\.\d+)?)$"
    n = lambda r, i: _group(s, r, i).cast("double")
    return F.coalesce(n(both, 1) + n(both, 2) / 12, n(foot, 1), n(inch, 1) / 12, n(bare, 1))


def name_date(file_name: Column) -> Column:
    """Date ``M.D.YY`` inside a file's name, if it is of 2019 to 2027."""
    r = r"(?:^|[^0-9.])(\d{1,2})\.(\d{1,2})\.(\d{2})(?:[^0-9]|$)"
    y = _group(file_name, r, 3).cast("int") + 2000
    return F.when(y.between(2019, 2027), _date(y, _group(file_name, r, 1).cast("int"), _group(file_name, r, 2).cast("int")))


def project_folder(path: Column) -> Column:
    """The path's component after ``+ITBs``, ``++Archive`` skipped; null without one."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: p != "++Archive")
    at = F.array_position(parts, F.lit("+ITBs"))
    return F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))


def slug(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " ,.", "_")


def exact(amount: Column) -> Column:
    """An amount as a decimal wide enough that products of cents and rates lose nothing, so sums don't depend on order."""
    return amount.cast("decimal(20,8)")


def cents(amount: Column) -> Column:
    """An exact amount in whole cents, half up, as double."""
    return F.round(amount, 2).cast("double")


def to_places(amount: Column, places: int) -> Column:
    """A double rounded half up by its decimal digits, so that a tie doesn't hang on the last bit."""
    return F.round(exact(amount), places).cast("double")
