"""Column expressions on text: trimming, cascades, entity cleaning, accents, titles, years, search tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s"
# Fixed values of the search tokeniser.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
SHORT_TOKENS = ("tvma", "pg13", "r", "tv14", "tvpg", "ma", "pg")
# Sequel numerals that stand between spaces.
NUMERALS = {" ii ": " 2 ", " iii ": " 3 ", " iv ": " 4 ", " v ": " 5 ", " vi ": " 6 ", " vii ": " 7 ", " viii ": " 8 ", " ix ": " 9 "}
# Fixed value: the certificates there are.
RATINGS = r"^(G|PG|PG-13|R|NC-17|NR|NOT RATED|UNRATED|TV-(Y7-FV|Y7|Y|G|PG|14|MA))\z"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"{SPACE}+\z|^{SPACE}+", "")


def match_first(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, stripped; '' without one (and for NULL)."""
    return F.coalesce(strip(F.regexp_extract(c, pattern, 1)), F.lit(""))


def first_nonempty(*columns: Column) -> Column:
    """The first value that is neither NULL nor ''; '' if there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def clean_entities(c: Column) -> Column:
    """A few entities decoded, in this order (so &amp;quot; decodes twice), white space collapsed. NULL gives ''."""
    c = F.coalesce(c, F.lit(""))
    for pattern, to in ((r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&quot;", '"'), (r"(?i)&#39;|&apos;", "'"), (rf"{SPACE}+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


@lru_cache(maxsize=1)
def _marked_letters() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one base character and marks, and what they decompose to."""
    source, target = [], []
    for code in [*range(0xC0, 0x2000), *range(0x1E00, 0x2000)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without the marks. Letters outside the table of marked letters stay."""
    source, target = _marked_letters()
    return F.regexp_replace(F.translate(c, source, target), r"\p{Mn}", "")


def _compat(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def _compat_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_compat)


def fold_compat(c: Column) -> Column:
    """Compatibility decomposition without marks, lower case. Only texts beyond Latin letters with marks leave the JVM."""
    beyond = c.rlike(r"[^\x{0}-\x{9f}\x{c0}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}]|\x{132}|\x{133}")
    return F.lower(F.coalesce(_compat_udf(F.when(beyond, c)), strip_accents(c)))


def normalize_title(c: Column) -> Column:
    """Title key: lower case, & as and, no accents, no film suffix or last parentheses, numerals between spaces as digits,
    only a-z and 0-9, no leading article. NULL gives ''; a title without a Latin letter or digit gives ''."""
    x = F.lower(strip(F.coalesce(c, F.lit(""))))
    x = strip_accents(F.replace(x, F.lit("&"), F.lit(" and ")))
    for pattern in (r"(?U)\s*\((?:\d{4}\s*)?film\)\s*\z", r"(?U)\s*\([^)]*\)\s*\z"):
        x = F.regexp_replace(x, pattern, "")
    for old, new in NUMERALS.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    x = F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    return F.regexp_replace(x, r"^(the|a|an) +", "")


def year_from_text(c: Column) -> Column:
    """The first year 1900..2099 between word boundaries; NULL without one."""
    return F.regexp_extract(c, r"(?U)\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")


def search_tokens(c: Column) -> Column:
    """Tokens of the search index: accents off, lower case, everything but word characters and hyphens parts; short
    hyphenated forms are glued (pg-13); stop words and words of one or two letters go, but for a few ratings."""
    t = F.regexp_replace(fold_compat(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s-]", " ")
    words = F.filter(F.split(F.trim(F.regexp_replace(t, rf"{SPACE}+", " ")), " "), lambda w: w != "")

    def glue(w: Column) -> Column:
        joined = F.replace(w, F.lit("-"), F.lit(""))
        letters = F.exists(F.split(w, "-"), lambda p: p.rlike(r"^\p{L}+$"))
        return F.when(w.contains("-") & letters & F.length(joined).between(1, 4), joined).otherwise(w)

    kept = lambda w: ~w.isin(*STOP_WORDS) & ((F.length(w) > 2) | w.isin(*SHORT_TOKENS))
    return F.filter(F.transform(words, glue), kept)


def ordered_unique(items: Column) -> Column:
    """Cleaned items without blanks, each at its first place."""
    return F.array_distinct(F.filter(F.transform(items, clean_entities), lambda x: x != ""))


def bounded_score(*candidates: Column) -> Column:
    """The first candidate whose first run of digits is a number from 0 to 100; NULL without one."""
    tried = [F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("int") for c in candidates]
    return F.coalesce(*[F.when(v.between(0, 100), v) for v in tried])


def normalize_rating(c: Column) -> Column:
    """A certificate in its usual spelling, or ''."""
    x = F.upper(strip(F.coalesce(c, F.lit(""))))
    for old, new in (("PG13", "PG-13"), ("NC17", "NC-17"), ("TV14", "TV-14"), ("TVPG", "TV-PG")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.when(x.rlike(RATINGS), x).otherwise("")


def iso_minutes(c: Column) -> Column:
    """Minutes of an ISO duration PT#H#M, 0 where both parts are missing; NULL where no PT occurs."""
    part = lambda g: F.coalesce(F.regexp_extract(c, r"(?i)PT(?:(\d+)H)?(?:(\d+)M)?", g).try_cast("int"), F.lit(0))
    return F.when(c.rlike("(?i)PT"), part(1) * 60 + part(2))


def hours_minutes(minutes: Column) -> Column:
    """`2h 16m`, `45m`; '' for NULL."""
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    return F.when(minutes.isNull(), "").when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def whitespace_tokens(c: Column) -> Column:
    """Number of words between white space; 0 for NULL and blank. (A plain count, not a vocabulary's.)"""
    t = strip(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, rf"{SPACE}+")))


def preview(text: Column, most: int = 220) -> Column:
    """The text, or its first characters and an ellipsis where it is longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def preview_list(items: Column, most: int = 6) -> Column:
    """The first items joined by commas, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.format_string(" +%d more", more)).otherwise(""))
