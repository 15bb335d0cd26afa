"""Reading of dates and instants written in many ways (worker-side Python)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from filmloom.functions.residue import strip_inline

# Month names of en, de, fr, es and zone abbreviations with their offsets in minutes.
MONTHS = {
    "january": 1, "jan": 1, "januar": 1, "jänner": 1, "janvier": 1, "janv": 1, "enero": 1, "ene": 1,
    "february": 2, "feb": 2, "februar": 2, "février": 2, "fevrier": 2, "févr": 2, "fév": 2, "febrero": 2,
    "march": 3, "mar": 3, "märz": 3, "maerz": 3, "mär": 3, "mrz": 3, "mars": 3, "marzo": 3,
    "april": 4, "apr": 4, "avril": 4, "avr": 4, "abril": 4, "abr": 4,
    "may": 5, "mai": 5, "mayo": 5,
    "june": 6, "jun": 6, "juni": 6, "juin": 6, "junio": 6,
    "july": 7, "jul": 7, "juli": 7, "juillet": 7, "juil": 7, "julio": 7,
    "august": 8, "aug": 8, "août": 8, "aout": 8, "agosto": 8, "ago": 8,
    "september": 9, "sep": 9, "sept": 9, "septembre": 9, "septiembre": 9, "set": 9,
    "october": 10, "oct": 10, "oktober": 10, "okt": 10, "octobre": 10, "octubre": 10,
    "november": 11, "nov": 11, "novembre": 11, "noviembre": 11,
    "december": 12, "dec": 12, "dezember": 12, "dez": 12, "décembre": 12, "decembre": 12, "déc": 12, "diciembre": 12, "dic": 12,
}
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "west": 60, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540,
    "aest": 600, "aedt": 660, "acst": 570, "awst": 480, "nzst": 720, "nzdt": 780, "brt": -180, "hst": -600,
}
GENERIC = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}

_M = "|".join(sorted(MONTHS, key=len, reverse=True))
_TIME = r"(?P<h>[01]?\d|2[0-4])[:.h](?P<mi>[0-5]\d)(?:[:.](?P<s>[0-5]\d|60)(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?:\s*(?P<z>Z(?![A-Za-z])|(?:UTC|GMT)\s*[+−-]\d{1,2}(?::?\d{2})?|[+−-]\d{2}(?::?\d{2})?(?![\d-])|[A-Z][A-Za-z]+/[A-Z][A-Za-z_]+(?:/[A-Z][A-Za-z_]+)?|(?:MESZ|MEZ|[A-Z]{2,4}T|UTC|GMT|ET|CT|MT|PT|UT|MSK)(?![A-Za-z])|\(?local(?:\s+time)?\)?))?"
_CLOCK = rf"(?:(?:\s*(?:,|T|t|at|um|à|a las|-)?\s*){_TIME}{_ZONE})?"
_NOT = r"(?<![\d/.-])"
_FORMS = [
    re.compile(rf"{_NOT}(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?!\d){_CLOCK}", re.I),
    re.compile(rf"{_NOT}(?P<a>\d{{1,2}})(?P<sep>[-/.])\s?(?P<b>\d{{1,2}})(?P=sep)\s?(?P<y>\d{{4}})(?!\d){_CLOCK}", re.I),
    re.compile(rf"(?<!\d)(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.|er|º|ª)?[\s-]*(?:of\s|de\s)?(?P<mon>{_M})\.?,?[\s-]*(?:de\s|del\s|of\s)?(?P<y>\d{{4}})(?!\d){_CLOCK}", re.I),
    re.compile(rf"(?<![^\W\d_])(?P<mon>{_M})\.?[\s-]*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?[\s-]+(?P<y>\d{{4}})(?!\d){_CLOCK}", re.I),
    re.compile(rf"(?<!\d)(?P<y>\d{{4}})[\s,-]+(?P<mon>{_M})\.?[\s-]*(?P<d>\d{{1,2}})(?!\d){_CLOCK}", re.I),
    re.compile(rf"(?<!\d)(?P<y>\d{{4}})\s*[年년]\s*(?P<m>\d{{1,2}})\s*[月월]\s*(?P<d>\d{{1,2}})\s*[日일]{_CLOCK}", re.I),
    re.compile(rf"{_NOT}(?P<y>(?:18|19|20)\d{{2}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[T ]?(?P<h>[01]\d|2[0-3])(?P<mi>[0-5]\d)(?P<s>[0-5]\d)?{_ZONE})?(?![\d.])", re.I),
    re.compile(rf"{_NOT}(?P<y>\d{{4}})-?W(?P<w>\d{{2}})-?(?P<wd>[1-7])(?!\d){_CLOCK}", re.I),
    re.compile(rf"{_NOT}(?P<y>(?:19|20)\d{{2}})-(?P<doy>[0-3]\d{{2}})(?![\d-]){_CLOCK}", re.I),
    re.compile(r"(?<![^\W\d_])(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?\s+(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+(?P<d>\d{1,2})\s+(?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})\s+(?:(?P<z>[A-Z]{3,4}|[+-]\d{4})\s+)?(?P<y>\d{4})", re.I),
]
_TEMPLATE = re.compile(r"\{\{\s*(?:film|start|end|release|birth)?[ _-]*(?:date|dts|release date)[^|{}]*\|([^{}]*)\}\}", re.I)
_EPOCH = re.compile(r"^[\s@*]*(-?\d{9,10}|-?\d{11,13}|\d{15,16}|\d{18,19})(\.\d+)?\s*(?:\([^()]*\)\s*)?$")


@dataclass(frozen=True)
class Stamp:
    """local is the written clock reading; offset its distance from UTC in minutes, or NULL with zone naming a region."""

    local: datetime
    precision: str  # day, minute, second, millisecond, microsecond
    offset: int | None
    zone: str | None  # region name, "local" (no zone stated) or NULL
    numeric: bool  # day and month in an order that the text alone leaves open


def _zone(text: str | None) -> tuple[int | None, str | None]:
    if not text:
        return None, "local"
    t = text.strip().strip("()").replace("−", "-")
    low = t.lower()
    if low.startswith("local"):
        return None, "local"
    if low in ZONES:
        return ZONES[low], None
    if low in GENERIC:
        return None, GENERIC[low]
    m = re.fullmatch(r"(?:utc|gmt)?\s*([+-])(\d{1,2}):?(\d{2})?", low)
    if m:
        minutes = int(m[2]) * 60 + int(m[3] or 0)
        return (-minutes if m[1] == "-" else minutes), None
    if "/" in t:
        try:
            ZoneInfo(t)
            return None, t
        except Exception:  # an unknown region is no zone
            return None, "local"
    return None, "local"


def _template(match: re.Match) -> str:
    parts = [p.strip() for p in match.group(1).split("|") if "=" not in p]
    out, i = [], 0
    while i < len(parts):
        if re.fullmatch(r"\d{4}", parts[i]):
            ymd = [parts[i]]
            while len(ymd) < 3 and i + 1 < len(parts) and re.fullmatch(r"\d{1,2}", parts[i + 1]):
                i += 1
                ymd.append(parts[i])
            clock = ""
            if len(ymd) == 3 and i + 2 < len(parts) and all(re.fullmatch(r"\d{1,2}", p) for p in parts[i + 1 : i + 3]):
                clock = f" {int(parts[i + 1]):02d}:{int(parts[i + 2]):02d}"
                i += 2
            out.append(f"{int(ymd[0]):04d}-{int(ymd[1]):02d}-{int(ymd[2]):02d}{clock}" if len(ymd) == 3 else "-".join(ymd))
        elif parts[i]:
            out.append(parts[i])
        i += 1
    return " ; ".join(out)


def stamps(text: str | None, date_order: str | None = None) -> list[Stamp]:
    """Every full date or instant stated, in order; impossible dates are left out. NULL and empty give [].

    date_order ("dmy" or "mdy") reads numeric dates that could be either; without one, day first.
    """
    if not text:
        return []
    e = _EPOCH.match(text)
    if e:
        return _epoch(e)
    t = _TEMPLATE.sub(_template, text) if "{{" in text else text
    t = strip_inline(t).replace(" ", " ").replace("​", "").strip()
    e = _EPOCH.match(t)
    if e:
        return _epoch(e)
    found: list[tuple[int, int, Stamp]] = []
    for form in _FORMS:
        for m in form.finditer(t):
            if any(m.start() < b and a < m.end() for a, b, _ in found):
                continue
            s = _stamp(m, date_order)
            if s:
                found.append((m.start(), m.end(), s))
    return [s for _, _, s in sorted(found, key=lambda x: x[0])]


def _epoch(m: re.Match) -> list[Stamp]:
    digits = m.group(1).lstrip("-")
    power = {9: 0, 10: 0, 11: 3, 12: 3, 13: 3, 15: 6, 16: 6, 18: 9, 19: 9}[len(digits)]
    micros = int(m.group(1)) * 10 ** (6 - power) if power <= 6 else int(m.group(1)) // 1000
    precision = {0: "second", 3: "millisecond"}.get(power, "microsecond")
    if m.group(2) and power == 0:
        frac = (m.group(2)[1:] + "000000")[:6]
        micros += int(frac)
        if frac.strip("0"):
            precision = "millisecond" if frac.endswith("000") else "microsecond"
    try:
        return [Stamp(datetime(1970, 1, 1) + timedelta(microseconds=micros), precision, 0, None, False)]
    except OverflowError:
        return []


def _stamp(m: re.Match, date_order: str | None) -> Stamp | None:
    g = m.groupdict()
    numeric = False
    try:
        if g.get("w"):
            day = date.fromisocalendar(int(g["y"]), int(g["w"]), int(g["wd"]))
        elif g.get("doy"):
            if not 1 <= int(g["doy"]) <= 366:
                return None
            day = date(int(g["y"]), 1, 1) + timedelta(days=int(g["doy"]) - 1)
            if day.year != int(g["y"]):
                return None
        elif g.get("a"):
            a, b = int(g["a"]), int(g["b"])
            numeric = a <= 12 and b <= 12 and a != b
            dotted = g["sep"] == "."
            mdy = (date_order == "mdy" and not dotted and a <= 12) or b > 12
            day = date(int(g["y"]), a, b) if mdy else date(int(g["y"]), b, a)
        else:
            month = MONTHS[g["mon"].lower()] if g.get("mon") else int(g["m"])
            day = date(int(g["y"]), month, int(g["d"]))
        if not g.get("h"):
            return Stamp(datetime(day.year, day.month, day.day), "day", None, None, numeric)
        hour, minute, second = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
        if g.get("ap"):
            if not 1 <= hour <= 12:
                return None
            hour = hour % 12 + (12 if g["ap"].lower() == "p" else 0)
        extra = 0
        if hour == 24 and minute == second == 0:
            hour, extra = 0, 1
        frac = (g.get("f") or "")[:6]
        leap = second == 60
        local = datetime(day.year, day.month, day.day, hour, minute, 59 if leap else second, int(frac.ljust(6, "0") or 0)) + timedelta(days=extra, seconds=int(leap))
        precision = "minute" if not g.get("s") else "second" if not frac else "millisecond" if len(frac) <= 3 else "microsecond"
        offset, zone = _zone(g.get("z"))
        return Stamp(local, precision, offset, zone, numeric)
    except (ValueError, OverflowError):
        return None


def to_utc(s: Stamp, region: str | None = None) -> tuple[datetime, str]:
    """The instant in UTC without zone, and how it was found: day, exact, zone, gap, fold, unknown.

    A local time in a spring gap is moved on by the gap, one in an autumn fold is its first occurrence.
    """
    if s.precision == "day":
        return s.local, "day"
    if s.offset is not None:
        try:
            return s.local - timedelta(minutes=s.offset), "exact"
        except OverflowError:
            return s.local, "unknown"
    name = region if s.zone == "local" else s.zone
    if not name:
        return s.local, "unknown"
    z = ZoneInfo(name)
    first, second = s.local.replace(tzinfo=z, fold=0), s.local.replace(tzinfo=z, fold=1)
    how = "zone"
    if first.utcoffset() != second.utcoffset():
        back = first.astimezone(timezone.utc).astimezone(z).replace(tzinfo=None)
        how = "fold" if back == s.local else "gap"
    return first.astimezone(UTC).replace(tzinfo=None), how


def is_plain(text: str) -> bool:
    """Whether the whole value already is YYYY-MM-DD or YYYY-MM-DDTHH:MM:SSZ."""
    return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}Z)?", text, re.A))
