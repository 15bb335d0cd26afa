"""Readings of an amount of money written by people: every combination of number, scale and currency a text allows."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from itertools import product

from filmloom.functions.residue import strip_inline

# ISO codes, signs and words of currencies. CODES are those of the rate table, read in either case; the other
# codes only in capitals.
CODES = ("USD", "GBP", "EUR", "INR", "JPY", "CAD", "AUD", "KRW", "SEK", "MXN", "PLN", "CHF", "BRL")
OTHER_CODES = (
    "AED AFN ALL AMD ANG AOA ARS AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BSD BTN BWP BYN BZD CDF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB FJD FKP GEL GHS GIP GMD GNF GTQ GYD HKD HNL "
    "HRK HTG HUF IDR ILS IQD IRR ISK JMD JOD KES KGS KHR KMF KPW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR "
    "PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL RMB"
).split()
SIGNS = {
    "US$": "USD", "U.S.$": "USD", "$US": "USD", "UK£": "GBP", "£": "GBP", "€": "EUR", "₹": "INR", "¥": "JPY", "JP¥": "JPY", "￥": "JPY", "円": "JPY",
    "C$": "CAD", "CA$": "CAD", "Can$": "CAD", "CDN$": "CAD", "A$": "AUD", "AU$": "AUD", "Aus$": "AUD", "₩": "KRW", "원": "KRW",
    "MX$": "MXN", "Mex$": "MXN", "zł": "PLN", "R$": "BRL", "Fr.": "CHF", "SFr.": "CHF", "sFr": "CHF", "Rs.": "INR", "Rs": "INR", "Re.": "INR",
    "kr": "SEK", "kr.": "SEK", "SKr": "SEK", "$": "USD",
    "NZ$": "NZD", "HK$": "HKD", "S$": "SGD", "NT$": "TWD", "CN¥": "CNY", "元": "CNY", "₽": "RUB", "₺": "TRY", "₫": "VND", "₴": "UAH", "₪": "ILS", "฿": "THB", "₱": "PHP", "₦": "NGN", "₸": "KZT", "Kč": "CZK", "DKr": "DKK", "NKr": "NOK",
}
WORDS = {
    "us dollar": "USD", "u.s. dollar": "USD", "american dollar": "USD", "canadian dollar": "CAD", "australian dollar": "AUD", "dollar": "USD", "buck": "USD",
    "pound sterling": "GBP", "pounds sterling": "GBP", "british pound": "GBP", "pound": "GBP", "sterling": "GBP", "quid": "GBP", "euro": "EUR",
    "indian rupee": "INR", "rupee": "INR", "yen": "JPY", "japanese yen": "JPY", "won": "KRW", "south korean won": "KRW", "korean won": "KRW",
    "swedish krona": "SEK", "swedish kronor": "SEK", "krona": "SEK", "kronor": "SEK", "mexican peso": "MXN", "peso": "MXN",
    "polish zloty": "PLN", "zloty": "PLN", "złoty": "PLN", "zlotych": "PLN", "złotych": "PLN", "swiss franc": "CHF", "franc": "CHF", "franken": "CHF",
    "brazilian real": "BRL", "real": "BRL", "reais": "BRL", "dollars canadiens": "CAD", "dólares": "USD", "dolares": "USD",
    "new zealand dollar": "NZD", "hong kong dollar": "HKD", "singapore dollar": "SGD", "taiwan dollar": "TWD", "new taiwan dollar": "TWD", "egyptian pound": "EGP", "pakistani rupee": "PKR", "sri lankan rupee": "LKR",
    "argentine peso": "ARS", "chilean peso": "CLP", "philippine peso": "PHP", "colombian peso": "COP", "danish krone": "DKK", "danish kroner": "DKK", "norwegian krone": "NOK", "norwegian kroner": "NOK",
    "krone": "kroner", "kroner": "kroner", "ruble": "RUB", "rouble": "RUB", "yuan": "CNY", "renminbi": "CNY", "baht": "THB", "rupiah": "IDR", "ringgit": "MYR", "forint": "HUF", "koruna": "CZK", "lira": "TRY", "rand": "ZAR", "shekel": "ILS", "hryvnia": "UAH", "naira": "NGN",
}
SCALES = {
    "hundred": 1e2, "thousand": 1e3, "thousands": 1e3, "tsd": 1e3, "tsd.": 1e3, "k": 1e3, "mille": 1e3, "mil mill": 1e9, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "millionen": 1e6, "millones": 1e6, "millón": 1e6, "milliones": 1e6, "mill": 1e6, "mill.": 1e6, "mil.": 1e6, "mil": 1e6,
    "mln": 1e6, "mln.": 1e6, "mn": 1e6, "mn.": 1e6, "mio": 1e6, "mio.": 1e6, "m": 1e6, "mm": 1e6,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "cr.": 1e7,
    "billion": 1e9, "billions": 1e9, "bil": 1e9, "bil.": 1e9, "bn": 1e9, "bn.": 1e9, "b": 1e9, "mrd": 1e9, "mrd.": 1e9, "milliard": 1e9, "milliards": 1e9, "milliarden": 1e9, "g": 1e9,
    "trillion": 1e12, "trillions": 1e12, "tn": 1e12, "百": 1e2, "백": 1e2, "千": 1e3, "천": 1e3, "万": 1e4, "萬": 1e4, "만": 1e4, "億": 1e8, "亿": 1e8, "억": 1e8, "兆": 1e12, "조": 1e12,
}
NUMBERS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "half": 0.5, "quarter": 0.25, "dozen": 12, "couple": 2,
}

_SUPERSCRIPT = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
_POWER = re.compile(r"(?:\s*[x×·*]\s*10\s*(?:\^|\*\*)?\s*\{?([0-9]{1,2})\}?(?![0-9])|[eE]\+?([0-9]{1,2})(?![0-9A-Za-z]))")
_DIGITS = r"\d{1,3}(?:[  ,.'’]\d{2,3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?"
_OTHER = rf"(?-i:{'|'.join(OTHER_CODES)})"
_SIGN_ALT = "|".join(sorted((re.escape(s) for s in SIGNS), key=len, reverse=True))
_WORD_ALT = "|".join(sorted((re.escape(w) for w in WORDS), key=len, reverse=True))
_SCALE_ALT = "|".join(sorted((re.escape(w) for w in SCALES), key=len, reverse=True))
_NUMBER_ALT = "|".join(sorted(NUMBERS, key=len, reverse=True))
_AMOUNT = re.compile(
    rf"(?P<pre>(?:\b(?:{'|'.join(CODES)})(?![A-Za-z])|\b{_OTHER}(?![A-Za-z])|(?<![A-Za-z])US\s(?=\$)|(?<![A-Za-z])(?:{_SIGN_ALT})|(?-i:(?<![A-Za-z])[A-Z]{{1,3}}\$)|(?-i:(?<![A-Z]))\$)[ \t]*(?:\$[ \t]*)?)?"
    rf"(?:(?P<num>{_DIGITS})|(?P<words>\b(?:{_NUMBER_ALT})(?:[ -](?:and[ -])?(?:{_NUMBER_ALT}|hundred))*\b))"
    rf"(?P<power>(?:\s*[x×·*]\s*10\s*(?:\^|\*\*)?\s*\{{?[0-9⁰¹²³⁴-⁹]{{1,2}}\}}?|[eE]\+?[0-9]{{1,2}}(?![0-9A-Za-z])))?"
    rf"(?P<scale>(?:[ -]*(?:an?[ ])?(?:{_SCALE_ALT})(?![A-Za-z])\.?){{0,2}})"
    rf"(?P<post>[ ]*(?:of[ ]|de[ ]|d')?(?:(?:{'|'.join(CODES)})(?![A-Za-z])|{_OTHER}(?![A-Za-z])|(?:{_WORD_ALT})(?:s|es|n)?(?![A-Za-z])|(?:{_SIGN_ALT})(?!\s*\d)))?",
    re.I,
)
_SCALE_ITEM = re.compile(rf"(?:{_SCALE_ALT})(?![A-Za-z])", re.I)
_MYRIAD, _BELOW = "万萬만億亿억兆조", "百백千천"
_GAP = re.compile(r"\s*(?:and\s)?\s*", re.I)
_JOIN = re.compile(r"^\s*(?:-|–|—|~|to|and|bis|à|a|y|und|et|or|through)\s*$", re.I)
_FOLD_SIGNS = {k.lower(): v for k, v in SIGNS.items()}


@dataclass(frozen=True)
class Reading:
    """low and high in the currency's units; scale is what one unit of the written number stands for, of a number in
    several scale groups that of the first; scale_open where the text leaves the scale open (a number below a thousand
    without any word of scale)."""

    low: float
    high: float
    scale: float
    currency: str
    stated: bool
    scale_open: bool = False


def _number_readings(text: str) -> list[float]:
    """Values a digit string can stand for; more than one where a lone separator may be decimal or grouping."""
    t = re.sub(r"[  '’]", "", text)
    seps = re.findall(r"[.,]", t)
    if not seps:
        return [float(t)]
    if len(set(seps)) == 2:  # the last kind is the decimal mark
        dec = seps[-1]
        if seps.count(dec) == 1:
            return [float(t.replace("," if dec == "." else ".", "").replace(dec, "."))]
        return [float(re.sub(r"[.,]", "", t))]
    if len(seps) > 1:
        parts = re.split(r"[.,]", t)
        return [float("".join(parts))]
    head, tail = re.split(r"[.,]", t)
    plain, decimal = float(head + tail), float(f"{head}.{tail}")
    if len(tail) == 3 and head != "0" and len(head) <= 3:
        return [plain, decimal] if seps[0] == "," else [decimal, plain]
    return [decimal]


def _word_value(text: str) -> float:
    total, current = 0.0, 0.0
    words = [w for w in re.split(r"[ -]+", text.lower()) if w != "and"]
    for i, w in enumerate(words):
        if w == "hundred":
            current = max(current, 1) * 100
        elif w in ("a", "an") and len(words) > 1:
            continue
        else:
            v = NUMBERS[w]
            current = current * v if v in (0.5, 0.25) and current else current + v
    return total + current


def _currency(text: str) -> str | None:
    t = re.sub(r"^(of|de|d')\s*", "", text.strip().lower()).strip()
    if not t:
        return None
    if t.upper()[:3] in (*CODES, *OTHER_CODES) and (len(t) == 3 or not t[3].isalpha()):
        return "CNY" if t.startswith("rmb") else t.upper()[:3]
    t2 = re.sub(r"\s+", "", t)
    if t2 in _FOLD_SIGNS:
        return _FOLD_SIGNS[t2]
    for form in (t, t.rstrip("s"), t.removesuffix("es"), t.rstrip("n")):
        if form in WORDS:
            return WORDS[form]
    # an unknown sign of dollars is a currency without a rate, never US dollars
    return t2.upper() if re.fullmatch(r"[a-z]{1,3}\$", t2) else None


def _numbers(m: re.Match) -> list[float]:
    return _number_readings(m.group("num")) if m.group("num") else [_word_value(m.group("words"))]


def _scales(m: re.Match) -> list[tuple[str, float]]:
    keys = [s.lower().strip() for s in _SCALE_ITEM.findall(m.group("scale") or "")]
    return [(k, SCALES.get(k, SCALES.get(k.rstrip("."), 1.0))) for k in keys]


def _scale(m: re.Match) -> float:
    scale = math.prod(v for _, v in _scales(m))
    if m.group("power"):
        digits = re.findall(r"[eE]\+?(\d{1,2})$|10\s*(?:\^|\*\*)?\s*\{?(\d{1,2})\}?$", m.group("power"))
        scale *= 10.0 ** int(next(x for x in digits[0] if x))
    return scale


def _split(m: re.Match) -> tuple[float, float]:
    """The scale of a group below the myriads and the rest of its scale: 千万 is 1000 times 10000."""
    below = math.prod(v for k, v in _scales(m) if k in _BELOW)
    return below, _scale(m) / below


def _continues(t: str, group: list[re.Match], m: re.Match) -> bool:
    """Whether m goes on with the number of the groups before it: 9000万円 after 5億, 50 lakh after 1 crore."""
    last = group[-1]
    gap = t[last.end() : m.start()]
    if m.group("pre") or (last.group("post") or "").strip() or last.group("power") or m.group("power") or not _GAP.fullmatch(gap):
        return False
    (below0, big0), (below, big) = _split(last), _split(m)
    if below0 * big0 == 1.0:
        return False
    if any(k in _MYRIAD + _BELOW for k, _ in _scales(last)):
        if gap.strip() or not m.group("num"):
            return False
        if below * big == 1.0:
            return not gap or bool(m.group("post"))
        # 千 and 百 count within the myriad that follows them: 2千5百万
        above = next((b for b in (_split(g)[1] for g in reversed(group)) if b != 1.0), math.inf)
        return below < below0 if big0 == big == 1.0 else big < above
    if "and" in gap.lower() and re.search(r"\bbetween\s[^\w]*$", t[: group[0].start()], re.I):
        return False
    if below * big == 1.0 and not (m.group("words") and m.group("post")):
        return False
    currencies = {c for c in (_currency(group[0].group("pre") or ""), _currency(m.group("post") or "")) if c}
    return len(currencies) < 2 and big0 > big and all(n == int(n) for n in _numbers(last)[:1]) and max(_numbers(m)) * below * big < below0 * big0


def _worth(group: list[re.Match]) -> list[float]:
    """The values of a number in several scale groups. Only its last group may have decimals, where there is a choice."""
    out = []
    for numbers in product(*[[n for n in _numbers(m) if n == int(n)] or _numbers(m) for m in group[:-1]], _numbers(group[-1])):
        total = section = 0.0
        for n, m in zip(numbers, group, strict=True):
            below, big = _split(m)
            section += n * below
            if big != 1.0:
                total, section = total + section * big, 0.0
        out.append(total + section)
    return out


def amount_readings(text: str | None) -> list[Reading]:
    """All readings of the first amount (or range) stated, the plainest first; [] where none is stated.

    References, comments and other markup do not count. NULL and empty texts give [].
    """
    if not text:
        return []
    t = re.sub(r"\s+", " ", strip_inline(text)).strip().translate(_SUPERSCRIPT)
    t = re.sub(r"(?<=\d)\s*(?:[x×·*])\s*10\s+(?=\d)", "x10^", t)
    found: list[list[re.Match]] = []
    for m in _AMOUNT.finditer(t):
        if found and _continues(t, found[-1], m):
            found[-1].append(m)
            continue
        if m.group("words") and not (m.group("scale").strip() or m.group("post")):
            continue
        if m.group("num") and (m.start() and t[m.start() - 1].isalpha() and not m.group("pre")):
            continue
        found.append([m])
    if not found:
        return []
    stated = [g for g in found if any((m.group(k) or "").strip() for m in g for k in ("pre", "post", "scale", "power"))]
    first = found.index(stated[0]) if stated else 0
    pair = [found[first]]
    # a range: the next amount after a joining word or dash, or the one before it
    if first > 0 and _JOIN.match(t[found[first - 1][-1].end() : found[first][0].start()]):
        pair = [found[first - 1], found[first]]
    elif first + 1 < len(found) and _JOIN.match(t[found[first][-1].end() : found[first + 1][0].start()]):
        pair = [found[first], found[first + 1]]
    if not stated and len(pair) == 1 and not re.fullmatch(r"[^\w]*(?:approx\.?|about|ca\.?|c\.|circa|est\.?|less than|more than|over|under|at least|up to|nearly|almost|around|~|<|>)?\s*[\d.,  '’]+\s*(?:\([^()]*\))?[^\w]*", t, re.I):
        return []
    values, scales, currencies = [], [], []
    for g in pair:
        values.append(_numbers(g[0]) if len(g) == 1 else _worth(g))
        scales.append(_scale(g[0]))
        currencies.append(_currency(g[0].group("pre") or "") or _currency(g[-1].group("post") or ""))
    currency = next((c for c in reversed(currencies) if c), None)
    # "C$5 to C$8 million": a unit named once at the end holds for both numbers
    scale = scales[-1]
    if len(pair) == 2 and scales[0] != 1.0 and scales[1] == 1.0:
        scale = scales[0]
    both = scales if len(pair) == 2 and scales[0] != 1.0 and scales[1] != 1.0 else [scale] * len(pair)
    times = [1.0 if len(g) > 1 else x for g, x in zip(pair, both, strict=True)]
    out, seen = [], set()
    for a in values[0]:
        for b in values[1] if len(pair) == 2 else [a]:
            low, high = sorted((a * times[0], b * times[-1]))
            if (low, high) not in seen:
                seen.add((low, high))
                out.append(Reading(low, high, max(both), currency or "USD", currency is not None, max(both) == 1.0 and high < 1000))
    # a number that may be in the thousands by its separator is written out in full
    return out if all(r.scale_open for r in out) else [replace(r, scale_open=False) for r in out]
