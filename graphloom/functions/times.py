"""Times as written in exports. Known forms are column expressions; what remains goes through a tolerant parser."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

# Offsets of zone names, in hours.
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "EET": 2, "EEST": 3, "CET": 1, "CEST": 2, "BST": 1, "WET": 0, "WEST": 1, "IST": 5.5,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Day-first forms of chat exports, two- and four-digit years, 12 and 24 hours.
CHAT_FORMS = [f"d/M/{y}, {t}" for y in ("yy", "yyyy") for t in ("h:mm:ss a", "h:mm a", "H:mm:ss", "H:mm")]


def chat_time(raw: Column) -> Column:
    """a chat stamp, with or without square brackets."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(raw, "[\\u202f\\u00a0]", " "), "[\\[\\]]", ""))
    spaced = F.regexp_replace(F.trim(bare), "(\\d)([AP]M)$", "$1 $2")
    short = spaced.rlike("^\\d{1,2}/\\d{1,2}/\\d{2},")
    return F.coalesce(*[F.when(short == ("yyyy" not in f), F.try_to_timestamp(spaced, F.lit(f))) for f in CHAT_FORMS])


def mail_time(raw: Column) -> Column:
    """an RFC 2822 date; the weekday is left out first, as the parser doesn't take it."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), "^[A-Za-z]{3},\\s*", ""), "\\s*\\([^)]*\\)\\s*$", "")
    offset = F.regexp_replace(bare, "\\s(GMT|UTC|UT|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(offset, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")])


def is_undated(raw: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return (low == "") | low.startswith("n/a") | low.startswith("undated") | low.startswith("none")


def _utc(t: datetime) -> datetime:
    """a time without a zone is UTC."""
    return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)


_CLOCK = re.compile(r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?")
_ZONE = re.compile(r"(?<![A-Za-z])(" + "|".join(sorted(ZONES, key=len, reverse=True)) + r")(?![A-Za-z])|([+-])(\d{2}):?(\d{2})\b")
_DATES = [
    (re.compile(r"\b(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})"), False),
    (re.compile(r"\b(?P<d>\d{1,2})[-/.](?P<m>\d{1,2})[-/.](?P<y>\d{4}|\d{2})\b"), False),
    (re.compile(r"\b(?P<d>\d{1,2})(?:st|nd|rd|th)?[- ]?(?P<m>[A-Za-z]{3,9})\.?,?[- ]?(?P<y>\d{4})\b"), True),
    (re.compile(r"\b(?P<m>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})\b"), True),
]


def _month(name: str) -> int:
    key = name[:3].lower()
    return MONTHS.index(key) + 1 if key in MONTHS else 0


def any_time(raw: str | None) -> datetime | None:
    """F04's tolerant tail: the first date of a known shape in a text, day before month, with a time and a zone if there
    is one; as UTC. Differs from month-first parsers on purpose, as these exports write the day first."""
    raw = (raw or "").strip()
    if not raw or raw.lower().startswith(("n/a", "undated", "none")):
        return None
    try:
        return _utc(parsedate_to_datetime(raw)) if re.match(r"([A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} .*[+-]\d{4}", raw) else _searched(raw)
    except (TypeError, ValueError):
        return _searched(raw)


def _searched(raw: str) -> datetime | None:
    for shape, named in _DATES:
        for m in shape.finditer(raw):
            year = int(m["y"]) + (2000 if len(m["y"]) == 2 else 0)
            month = _month(m["m"]) if named else int(m["m"])
            clock = _CLOCK.search(raw)
            hour, minute, second = (int(clock[1]), int(clock[2]), int(clock[3] or 0)) if clock else (0, 0, 0)
            if clock and clock[4]:
                hour = hour % 12 + 12 * (clock[4].lower() == "pm")
            try:
                t = datetime(year, month, int(m["d"]), hour, minute, second)
            except ValueError:
                continue
            zone = _ZONE.search(raw[clock.end() :]) if clock else None
            if zone:
                hours = ZONES[zone[1]] if zone[1] else (1 if zone[2] == "+" else -1) * (int(zone[3]) + int(zone[4]) / 60)
                t -= timedelta(hours=hours)
            return t
    return None


def any_time_column(raw: Column | str) -> Column:
    """``any_time`` over Arrow batches."""
    return _any_time(raw)


@F.pandas_udf(TimestampType())
def _any_time(raw: pd.Series) -> pd.Series:
    return pd.Series([any_time(x) for x in raw], dtype="datetime64[us]").dt.tz_localize("UTC")


def item_time(kind: str, raw: str | None) -> datetime | None:
    """F04 for one value, for readers that work file by file."""
    if kind == "whatsapp" and (m := re.search(r"(\d{1,2})/(\d{1,2})/(\d{2,4}),", raw or "")):
        return _searched(f"{m[1]}/{m[2]}/{m[3]} {(raw or '')[m.end():].strip('[] ')}".replace(" ", " "))
    return any_time(raw)


# The shapes in which documents write their date.
DOCUMENT_DATES = {
    "ymd": "\\b(20\\d{2}-\\d{1,2}-\\d{1,2})\\b",
    "dmy": "\\b(\\d{1,2}[-/]\\d{1,2}[-/]20\\d{2})\\b",
    "dMy": "\\b(\\d{1,2}[- ]?[A-Za-z]{3,9}[- ]?20\\d{2})\\b",
    "Mdy": "\\b([A-Za-z]{3,9}\\s+\\d{1,2},?\\s+20\\d{2})\\b",
}


def document_date(text: Column) -> Column:
    """The earliest date of any known shape in a text."""
    part = lambda x, p: F.regexp_extract(x, p, 1)
    month = lambda x: F.initcap(F.left(part(x, "([A-Za-z]{3,9})"), F.lit(3)))
    year = lambda x: part(x, "(20\\d{2})")

    def dated(shape: str, x: Column) -> Column:
        if shape == "ymd":
            return F.try_to_timestamp(x, F.lit("yyyy-M-d"))
        if shape == "dmy":
            return F.try_to_timestamp(F.regexp_replace(x, "/", "-"), F.lit("d-M-yyyy"))
        day = part(x, "^(\\d{1,2})") if shape == "dMy" else part(x, "\\s(\\d{1,2}),?\\s")
        return F.try_to_timestamp(F.concat_ws(" ", day, month(x), year(x)), F.lit("d MMM yyyy"))

    def all_of(shape: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: dated(shape, x))

    found = [all_of(shape, pattern) for shape, pattern in DOCUMENT_DATES.items()]
    return F.array_min(F.filter(F.concat(*found), lambda t: t.isNotNull()))
