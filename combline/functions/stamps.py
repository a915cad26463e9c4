"""Grammar of written instants: one epoch second for a text that denotes exactly one instant, else nothing."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal, InvalidOperation
from zoneinfo import ZoneInfo

#: The accepted range, 2000-01-01 up to and excluding 2036-01-01 UTC.
FIRST_S, END_S = 946_684_800, 2_082_758_400
#: Zone abbreviations as hours from UTC.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}

_NUMBER = re.compile(r"[+]?\d+(?:\.\d*)?(?:e[+-]?\d+)?", re.I)
_TIME = r"(?P<h>\d{1,2})(?:[:.h](?P<mi>\d{2})(?::?(?P<s>\d{2})(?:[.,]\d+)?)?)?(?:\s*(?:(?P<half>[ap])\.?m\.?|uhr)(?![a-z]))?"
_ZONE = r"(?:\s*(?P<zone>z|utc|gmt|[ecmp][sd]t|[+-]\d{2}(?::?\d{2})?|\[[a-z_]+(?:/[a-z_]+)+\]|[a-z_]+(?:/[a-z_]+)+))?"
_DATED = [
    re.compile(p + _ZONE, re.I)
    for p in (
        r"(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})(?:t|\s+)" + _TIME,
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:t|\s+)(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,]\d+)?(?P<half>(?!))?",
        r"(?P<mo>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4}),?\s+" + _TIME,
        r"(?P<d>\d{1,2})\.(?P<mo>\d{1,2})\.(?P<y>\d{4}),?\s+" + _TIME,
        r"(?:[a-z]{3,9},?\s+)?(?P<mon>[a-z]{3,9})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4}),?\s+" + _TIME,
        r"(?:[a-z]{3,9},?\s+)?(?P<d>\d{1,2})\s+(?P<mon>[a-z]{3,9})\.?,?\s+(?P<y>\d{4}),?\s+" + _TIME,
    )
]
_FOUR = re.compile(r"(?P<h>\d{2})(?P<mi>\d{2})(?P<s>(?!))?(?P<half>(?!))?" + _ZONE, re.I)
_CLOCK = re.compile(r"t?" + _TIME + _ZONE, re.I)
_EDGE = " \t\r\n\f\v\xa0\"'“”"


def trimmed(text: str) -> str:
    """Without surrounding blanks and quotes and a final full stop."""
    while True:
        was, text = text, text.strip(_EDGE).removesuffix(".")
        if was == text:
            return text


def _offset(wall: datetime, zone: str | None, local: ZoneInfo) -> timedelta | None:
    """Offset from UTC of the wall time; none if the zone gives it twice or never."""
    if zone:
        name = zone.lower()
        if name in ABBREVIATIONS:
            return timedelta(hours=ABBREVIATIONS[name])
        if name[0] in "+-":
            digits = name[1:].replace(":", "")
            by = timedelta(hours=int(digits[:2]), minutes=int(digits[2:] or 0))
            if by > timedelta(hours=14) or int(digits[2:] or 0) > 59:
                return None
            return -by if name[0] == "-" else by
        try:
            local = ZoneInfo(zone.strip("[]"))
        except Exception:
            return None
    early, late = (wall.replace(tzinfo=local, fold=f).utcoffset() for f in (0, 1))
    return early if early == late else None


def _instant(m: re.Match, day: date | None, local: ZoneInfo) -> int | None:
    g = m.groupdict()
    if g["mi"] is None and not g["half"]:
        return None  # a bare hour is no time of day unless am or pm says so
    h = int(g["h"])
    if g["half"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["half"].lower() == "p" else 0)
    try:
        if day is None:
            month = MONTHS.get(g["mon"][:3].lower(), 0) if g.get("mon") else int(g["mo"])
            day = date(int(g["y"]), month, int(g["d"]))
        wall = datetime(day.year, day.month, day.day, h, int(g["mi"] or 0), int(g["s"] or 0))
        by = _offset(wall, g["zone"], local)
        return None if by is None else int((wall.replace(tzinfo=timezone.utc) - by).timestamp())
    except (ValueError, OverflowError):
        return None


def _number(text: str) -> int | None:
    try:
        value = Decimal(text)
    except InvalidOperation:
        return None
    if value.adjusted() > 30:
        return None
    for unit in (1, 1_000, 1_000_000, 1_000_000_000):
        if FIRST_S * unit <= value < END_S * unit:
            return int(value // unit)
    return None


def parse_stamp(text: str | None, local: ZoneInfo, day: date | None = None) -> int | None:
    """Epoch second of a stamp, or, with day, of a clock time on that calendar day (in the zone in which it is written).

    None for null, blank or unreadable texts, for local times that the zone has twice or never, and out of range.
    """
    if not text:
        return None
    text = trimmed(text)
    if day is not None:
        m = _FOUR.fullmatch(text) or _CLOCK.fullmatch(text)
        at = _instant(m, day, local) if m else None
    elif _NUMBER.fullmatch(text):
        at = _number(text)
    else:
        at = next((a for m in (p.fullmatch(text) for p in _DATED) if m and (a := _instant(m, None, local)) is not None), None)
    return at if at is not None and FIRST_S <= at < END_S else None
