"""Prices, ratings, dates, links, hashes and times as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain import fixed_values as fixed
from pagegrain.functions.text import strip


def parse_price(text: Column) -> Column:
    """Number in a price text; null where there is none. The sign is not kept."""
    kept = F.regexp_replace(text, r"[^0-9.,]", "")
    # Comma is the decimal mark when it comes after every dot, or stands alone
    # with at most two digits behind the last one.
    decimal_comma = kept.rlike(r"^[0-9,]*,[0-9]{0,2}$|\.[0-9.,]*,[0-9]*$")
    plain = F.when(decimal_comma, F.translate(kept, ",.", ".")).otherwise(F.translate(kept, ",", ""))
    return plain.try_cast("double")


def two_decimals(amount: Column) -> Column:
    """Text with two decimals, rounded on the exact binary value, true ties to even.

    ``round`` and ``bround`` work on the shortest decimal form of a double and so
    differ where that form only looks like a tie (1.225, 2.675).
    """
    return F.call_function("format_number", amount, F.lit("0.00"))


def round_cents(amount: Column) -> Column:
    return two_decimals(amount).try_cast("double")


def parse_rating(text: Column) -> Column:
    """First number of a rating text on a scale of five; tests run in a fixed order."""
    number = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    low = F.lower(text)

    def scale(top: str) -> Column:
        return low.contains(f"out of {top}") | text.contains(f"/{top}") | text.endswith(top)

    return (
        F.when(scale("5"), number)
        .when(scale("10"), number / 2.0)
        .when(scale("100") | text.contains("%"), number / 20.0)
        .otherwise(number)
    )


# A day may be a space and one digit, as the usual %d directive allows.
_YEAR = r"((?!0000)[0-9]{4})"
_DAY = r"(?: (?=[1-9](?![0-9])))?([0-9]{1,2})"
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|"
    "aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_SPACE = fixed.SPACE_RUN
_YEAR_FIRST = rf"^{_YEAR}([-/])([0-9]{{1,2}})\2{_DAY}\z"
_DAY_FIRST = rf"^([0-9]{{1,2}})([-/])([0-9]{{1,2}})\2{_YEAR}\z"
_MONTH_FIRST = rf"^([0-9]{{1,2}})([-/]){_DAY}\2{_YEAR}\z"
_NAME_DAY = rf"(?i)^{_MONTH}{_SPACE}{_DAY},{_SPACE}{_YEAR}\z"
_DAY_NAME = rf"(?i)^([0-9]{{1,2}}){_SPACE}{_MONTH}{_SPACE}{_YEAR}\z"
_CLOCK = r"((?:2[0-3]|[01][0-9]|[0-9]):(?:[0-5][0-9]|[0-9]):(?:[0-5][0-9]|[0-9]))"
# A fraction, and a Z behind it, only after the T form.
_DATE_TIME = (
    rf"^{_YEAR}-([0-9]{{1,2}})-{_DAY}"
    rf"(?:{_SPACE}{_CLOCK}|[Tt]{_CLOCK}(?:(\.[0-9]{{1,6}})[Zz]?)?)\z"
)
_ANY_YEAR_FIRST = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
_ANY_DAY_FIRST = r"([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})"


def _date(text: Column) -> Column:
    """ISO text at midnight of a ``year-month-day`` text; null unless such a day exists."""
    day = F.when(~text.startswith("0000"), text).try_cast("date")
    return F.concat(day.cast("string"), F.lit("T00:00:00"))


def _month_number(name: Column) -> Column:
    place = F.position(F.lower(F.left(name, F.lit(3))), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.floor((place + 2) / 3).cast("string")


def _named_month(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """Date text with a month name: bring the parts in order, then put the number in."""
    parts = F.split(F.regexp_replace(text, pattern, f"${year}-${month}-${day}"), "-")
    return F.concat_ws("-", F.get(parts, F.lit(0)), _month_number(F.get(parts, F.lit(1))), F.get(parts, F.lit(2)))


def _date_time(text: Column) -> Column:
    moment = F.regexp_replace(text, _DATE_TIME, "$1-$2-$3 $4$5$6").try_cast("timestamp_ntz")
    shown = F.translate(moment.cast("string"), " ", "T")
    return F.when(shown.contains("."), F.rpad(shown, 26, "0")).otherwise(shown)


def parse_date(text: Column) -> Column:
    """ISO text of a date written in one of the known formats, else the stripped text.

    Full-match formats come first (day before month where both fit); after them
    any year-first, then any day-first, date inside the text. A year-first match
    that is no calendar date ends the search.
    """
    text = strip(text)
    reorder = F.regexp_replace
    found = F.regexp_substr(text, F.lit(_ANY_YEAR_FIRST))
    found_late = F.regexp_substr(text, F.lit(_ANY_DAY_FIRST))
    parsed = F.coalesce(
        F.when(text.rlike(_YEAR_FIRST), _date(reorder(text, _YEAR_FIRST, "$1-$3-$4"))),
        F.when(
            text.rlike(_MONTH_FIRST),
            F.coalesce(
                _date(reorder(text, _DAY_FIRST, "$4-$3-$1")),
                _date(reorder(text, _MONTH_FIRST, "$4-$1-$3")),
            ),
        ),
        F.when(text.rlike(_DATE_TIME), _date_time(text)),
        F.when(text.rlike(_NAME_DAY), _date(_named_month(text, _NAME_DAY, 3, 1, 2))),
        F.when(text.rlike(_DAY_NAME), _date(_named_month(text, _DAY_NAME, 3, 2, 1))),
        F.when(found.isNotNull(), _date(F.translate(found, "/", "-"))).otherwise(
            _date(reorder(found_late, _ANY_DAY_FIRST, "$3-$2-$1"))
        ),
    )
    return F.coalesce(F.when(text.rlike("[0-9]{4}"), parsed), text)


def iso_timestamp(text: Column) -> Column:
    """TIMESTAMP_NTZ beside an ISO date text; null where the text is no date."""
    return text.try_cast("timestamp_ntz")


def with_scheme(text: Column) -> Column:
    """Strip a link and put ``https://`` before it unless it already has a web scheme."""
    link = strip(text)
    has_scheme = link.startswith("http://") | link.startswith("https://")
    return F.when((link == "") | has_scheme, link).otherwise(F.concat(F.lit("https://"), link))


def escape_spaces(link: Column) -> Column:
    return F.replace(link, F.lit(" "), F.lit("%20"))


def md5_hex(text: Column) -> Column:
    return F.md5(text)


def task_id(url: Column, description: Column) -> Column:
    return F.md5(F.concat(url, F.lit("_"), description))


def format_epoch(seconds: Column, fmt: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """Epoch seconds as text in the session time zone, from a strftime format."""
    pattern = ""
    for piece in re.findall(r"%.?|[^%]+", fmt, re.DOTALL):
        if piece in fixed.STRFTIME_PATTERNS:
            pattern += fixed.STRFTIME_PATTERNS[piece]
        elif piece.startswith("%"):
            raise ValueError(f"unsupported time directive {piece!r}")
        else:
            pattern += "'" + piece.replace("'", "''") + "'"
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), pattern)


def format_elapsed(seconds: Column) -> Column:
    """``x.xx seconds``, ``minutes`` from 60 and ``hours`` from 3600."""

    def amount(value: Column, unit: str) -> Column:
        return F.concat(two_decimals(value), F.lit(f" {unit}"))

    seconds = seconds.cast("double")
    return (
        F.when(seconds < 60, amount(seconds, "seconds"))
        .when(seconds < 3600, amount(seconds / 60, "minutes"))
        .otherwise(amount(seconds / 3600, "hours"))
    )
