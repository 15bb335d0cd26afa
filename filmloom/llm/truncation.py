"""Detection of texts that were cut, by a backward character n-gram model of line ends.

Looking backward from a position, the last characters tell how likely a line ends
there, in the text's language. Every line of every text but the last is known to be
whole: its last position is an end, its other positions are continuations. Ends of
texts are counted once per distinct end of two sentences, and never in judging the text itself.
A text whose final context rather continues is cut; the threshold on the log-odds is
set for every language and source at the valley between whole and cut texts, each
leaning on its language and all texts the more, the fewer texts it has.

The model is a table of n-gram counts. Only n-grams that the end of some text asks
for are counted: a bit field of fixed size, learnt from the ends, keeps the others
out of the shuffle (what it lets through by chance meets no end and changes nothing).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.session import cut

ORDERS = 6
BASE = np.uint64(0x9E3779B97F4A7C15)
SMOOTH = 3.0
BIN = 0.5
LOWEST, HIGHEST = -14.0, 10.0
ENOUGH = 2000
FILTER_BITS = 24
CHUNK_CHARS = 400_000
KEPT_NGRAMS = 1_000_000
SALTS = 16

# Marks put after a cut, and what may follow the mark of a sentence's end.
_BRACKETED = {"]": ("[", ("...", "…", "truncated", "cut", "more")), ")": ("(", ("...", "…", "more", "continued"))}
_WORDED = ("…", "&hellip;", "»»", ">>")
_URL_END = re.compile(r"(?:^|\s)(?:https?://|www\.)\S*$")
_AFTER_MARKUP = re.compile(r"[>\]}`$]\s+([^<>\[\]{}`$\\]*)$")
_LABEL = re.compile(r"^[^\W\d_][\w' ]{0,24}:\s")
_NUMBERED = re.compile(r"^\d{1,3}[.)]\s")
_BOUNDS = ("\n", ". ", "! ", "? ")
_ENDERS = ".!?…)\"'»”’]>"


def strip_marks(text: str) -> str:
    """The text without white space and marks of a cut at its end, however many there are."""
    while True:
        text = text.rstrip()
        dots = len(text) - len(text.rstrip("."))
        if dots >= 3:
            text = text[: len(text) - dots]
            continue
        worded = next((w for w in _WORDED if text[-len(w) :].lower() == w), None)
        if worded:
            text = text[: len(text) - len(worded)]
            continue
        opening, words = _BRACKETED.get(text[-1:], ("", ()))
        at = text.rfind(opening) if opening else -1
        if at < 0 or text[at + 1 : -1].strip().lower() not in words:
            return text
        text = text[:at]


def line_kind(line: str, first: bool) -> str:
    """Class of a line by how it starts: what ends it depends on that."""
    s = line.lstrip()
    if not s:
        return "0"
    if ("://" in s or "www." in s) and _URL_END.search(s):
        return "U"
    c = s[0]
    if c.isdigit() and _NUMBERED.match(s):
        return "1"
    if c in "-*•·" and s[1:2] in (" ", "\t"):
        return "B"
    if c in "<\\[`${":  # markup first, but a sentence after it
        rest = _AFTER_MARKUP.search(s)
        if rest and len(rest.group(1)) >= 20:
            return "P"
    if c in "#<\\[`$={|—–>&{}\"'(":
        return "-" if c in "—–" else c
    if ":" in s[:27] and _LABEL.match(s):
        return "L"
    return "F" if first else "P"


def tail_of(text: str) -> tuple[str, str, str]:
    """Kind of the last line that isn't blank, its last characters without a mark of a cut ('' for none), and the text's
    end from the last sentence or line but one on, by which copies are known."""
    body = strip_marks(text)
    line = body[body.rfind("\n") + 1 :]
    kind = line_kind(line, False)
    if kind in ("1", "B", "L") and len(body) < len(text.rstrip()):
        kind = "P"  # list items don't end in dots: a sentence follows the last one
    at = len(body)
    for _ in range(2):
        at = max(0, *(body.rfind(mark, 0, at) for mark in _BOUNDS))
    return kind, line[-ORDERS:], body[at:]


@lru_cache(maxsize=100_000)
def _seed(lang: str, kind: str, n: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(f"{lang}\x1f{kind}\x1f{n}".encode(), digest_size=8).digest(), dtype=np.uint64)[0]


def keys_of(codes: np.ndarray, lang: str, kind: str, n: int) -> np.ndarray:
    """64-bit keys of n-gram codes of a language and kind of line; wrapping arithmetic."""
    with np.errstate(over="ignore"):
        k = (codes ^ _seed(lang, kind, n)) * np.uint64(0xFF51AFD7ED558CCD)
        return k ^ (k >> np.uint64(32))


def codes_of(chars: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 1..ORDERS the code of the n characters before and at each position (uint64 arithmetic wraps)."""
    power = np.uint64(1)
    code = np.zeros(len(chars), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(ORDERS):
            code[n:] += (chars[: len(chars) - n] if n else chars) * power
            power = power * BASE
            yield code.copy()


def _line_events(texts: list[str]) -> dict[str, list[str]]:
    """Lines of the texts by kind. Of a text's last line, nothing tells that it is whole: it goes under its kind with a
    leading mark, and only its inner positions count."""
    by: dict[str, list[str]] = {}
    for t in texts:
        lines = t.split("\n")
        while lines and not lines[-1].strip():
            lines.pop()
        last = len(lines) - 1
        for i, line in enumerate(lines):
            line = line.rstrip()
            if line:
                if i == last:
                    by.setdefault("+" + line_kind(line, False), []).append(strip_marks(line))
                else:
                    by.setdefault(line_kind(line, i == 0), []).append(line)
    return by


_ENDER_CODES = np.array([ord(c) for c in _ENDERS], dtype=np.uint64)


def _occurrences(lang: str, kind: str, lines: list[str], asked: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, keys, whether the line ends there) of the positions of lines, of those only that pass the bit field."""
    whole = not kind.startswith("+")
    kind = kind.lstrip("+")
    pad = "\x02" * ORDERS
    joined = pad + ("\x03" + pad).join(lines) + "\x03"
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    following = np.append(chars[1:], np.uint64(3))
    real = (chars != 2) & (chars != 3)
    ends = real & (following == 3)
    # a sentence's end within a line is neither an end of the line nor a continuation of the sentence
    if kind == "L":  # "Cast: A, B": an item is whole where the next one begins
        ends |= real & (following == 44)
    breaks = np.isin(chars, _ENDER_CODES) & np.isin(following, np.array([32, 9, 60], dtype=np.uint64))
    used = real & (ends | ~breaks)
    if not whole:
        used &= following != 3
        if kind != "L":
            used &= ~ends
    ends = ends[used]
    for n, code in enumerate(codes_of(chars), 1):
        keys = keys_of(code[used], lang, kind, n)
        if asked is None:
            yield n, keys, ends
        else:
            bit = keys >> np.uint64(64 - FILTER_BITS)
            hit = (asked[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
            yield n, keys[hit], ends[hit]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts (columns: goes on, ends) added up."""
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    both = np.concatenate(counts)
    return values, np.stack([np.bincount(inverse, weights=both[:, k], minlength=len(values)) for k in (0, 1)], axis=1).astype(np.int64)


def asked_bits(keys: DataFrame, column: str = "key") -> np.ndarray:
    """The bit field of the keys: 2**FILTER_BITS bits (2 MB), whatever the number of keys."""
    bit = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS)
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int")).alias("m"))
    field = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).collect():  # at most 2**18 rows
        field[r.w] = r.m
    return field.view(np.uint64)


def count_ngrams(texts: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """(key, n, goes_on, ends): counts of the n-grams (all, or those asked for) over all lines of all texts, whole length.

    texts (lang, text). Texts are counted in chunks and what is kept in a task is bounded: it is passed on when it grows
    beyond KEPT_NGRAMS.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: dict[int, list] = {n: [] for n in range(1, ORDERS + 1)}
        counts: dict[int, list] = {n: [] for n in range(1, ORDERS + 1)}
        pending = 0

        def out() -> Iterator[pd.DataFrame]:
            for n in keys:
                if keys[n]:
                    values, both = _summed(keys[n], counts[n])
                    yield pd.DataFrame({"key": values.view(np.int64), "n": np.int32(n), "goes_on": both[:, 0], "ends": both[:, 1]})
                    keys[n], counts[n] = [], []

        def take(lang: str, group: list[str]) -> None:
            nonlocal pending
            for kind, lines in _line_events(group).items():
                for n, k, ends in _occurrences(lang, kind, lines, asked):
                    if len(k):
                        values, both = _summed([k], [np.stack([~ends, ends], axis=1)])
                        keys[n].append(values)
                        counts[n].append(both)
                        pending += len(values)

        for pdf in batches:
            for lang, part in pdf.groupby(pdf["lang"].fillna(""), sort=False)["text"]:
                group: list[str] = []
                size = 0
                for t in part:
                    if t:
                        group.append(t)
                        size += len(t)
                    if size >= CHUNK_CHARS:
                        take(lang, group)
                        group, size = [], 0
                if group:
                    take(lang, group)
                if pending > KEPT_NGRAMS:
                    for n in keys:
                        if len(keys[n]) > 1:
                            values, both = _summed(keys[n], counts[n])
                            keys[n], counts[n] = [values], [both]
                    pending = sum(len(k[0]) for k in keys.values() if k)
                    if pending > KEPT_NGRAMS // 2:
                        yield from out()
                        pending = 0
        yield from out()

    counted = texts.select("lang", "text").mapInPandas(run, "key long, n int, goes_on long, ends long")
    return counted.groupBy("key", "n").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))


TAIL = T.StructType([T.StructField("end", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


@F.pandas_udf(TAIL)
def _tails(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
    found = [tail_of(t) for t in texts]
    langs = [lang or "" for lang in langs]
    last = "".join(line.rjust(ORDERS, "\x02") for _, line, _ in found)
    chars = np.frombuffer(last.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64).reshape(-1, ORDERS)
    keys = np.zeros((len(found), ORDERS), dtype=np.uint64)
    code, power = np.zeros(len(found), dtype=np.uint64), np.uint64(1)
    by: dict[tuple[str, str], list[int]] = {}
    for i, (kind, _, _) in enumerate(found):
        by.setdefault((langs[i], kind), []).append(i)
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS + 1):
            code = code + chars[:, ORDERS - n] * power
            power = power * BASE
            for (lang, kind), rows in by.items():
                keys[rows, n - 1] = keys_of(code[rows], lang, kind, n)
    ends = [int.from_bytes(hashlib.blake2b(f"{lang}\x1f{kind}\x1f{end}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for lang, (kind, _, end) in zip(langs, found, strict=True)]
    return pd.DataFrame({"end": ends, "keys": list(keys.view(np.int64))})


def _log_odds(counts: Column) -> Column:
    """Log-odds of an end from an array of (n, goes_on, ends), lower orders first; the text's own end is left out."""
    p = F.aggregate(F.array_sort(counts), F.lit(0.5), lambda p, r: (F.greatest(r["ends"] - 1, F.lit(0)) + SMOOTH * p) / (F.greatest(r["ends"] - 1, F.lit(0)) + r["goes_on"] + SMOOTH))
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def score(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, log_odds) of an end at the end of each text. NULL and blank texts are left out; texts without
    a language are a language of their own."""
    texts = documents.where("text IS NOT NULL AND trim(text) <> ''")
    tails = cut(texts.select("doc_id", "lang", "source", _tails("text", "lang").alias("t")).select("doc_id", "lang", "source", "t.end", "t.keys", F.element_at("t.keys", -1).alias("context")))
    # the longest key of an end tells its shorter ones: one row per distinct context, however many texts end so
    contexts = tails.groupBy("context").agg(F.first("keys").alias("keys"), F.count_distinct("end").alias("distinct_ends"))
    each = cut(contexts.select("context", "distinct_ends", F.posexplode("keys").alias("i", "key")).select("context", "distinct_ends", "key", (F.col("i") + 1).alias("n")))
    model = count_ngrams(texts, asked_bits(each))
    # ends of texts: once per distinct end of two sentences, so that copies of a cut text do not vouch for each other
    own = each.groupBy("key", "n").agg(F.lit(0).cast("long").alias("goes_on"), F.sum("distinct_ends").alias("ends"))
    model = model.unionByName(own).groupBy("key", "n").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    # short n-grams end most contexts: their rows are dealt, the others have one part
    parts = F.when(F.col("n") <= 2, SALTS).otherwise(1)
    asked = each.withColumn("part", F.pmod(F.xxhash64("context"), parts).cast("int"))
    dealt = model.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    odds = asked.join(dealt, ["key", "n", "part"]).groupBy("context").agg(_log_odds(F.collect_list(F.struct("n", "goes_on", "ends"))).alias("log_odds"))  # ORDERS rows each
    return tails.join(odds, "context").select("doc_id", "lang", "source", "log_odds")


def valley(counts: dict[int, float], low: float = -6.0, high: float = -0.5) -> float:
    """The log-odds between low and high where the histogram (bin -> count) is thinnest; the middle of the widest gap."""
    bins = range(int(low / BIN), int(high / BIN) + 1)
    heights = [sum(counts.get(b + k, 0) * w for k, w in ((-1, 0.5), (0, 1.0), (1, 0.5))) for b in bins]
    least = min(heights)
    flat = [b for b, h in zip(bins, heights, strict=True) if h <= least * 1.05 + 0.5]
    return (flat[len(flat) // 2] + 0.5) * BIN


def _blend(counts: dict[int, int], wider: dict[int, float], weight: float) -> dict[int, float]:
    """The histogram with that of a wider group added, which counts as `weight` texts."""
    share = weight / sum(wider.values())
    return {b: counts.get(b, 0) + share * wider.get(b, 0) for b in {*counts, *wider}}


def thresholds(scored: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(lang, source, threshold), '' for NULL: one row per language and source.

    One rule at every size: the histogram of all texts counts as `enough` texts in that of a language, and this one as
    `enough` in that of each of its sources. Histograms have at most as many rows as bins; only that of all texts comes
    to the driver.
    """
    binned = scored.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.floor(F.greatest(F.least("log_odds", F.lit(HIGHEST)), F.lit(LOWEST)) / BIN).cast("int").alias("bin"))
    cells = cut(binned.groupBy("lang", "source", "bin").agg(F.count("*").alias("n")))
    overall = {r.bin: r.n for r in cells.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    general = valley(overall) if overall else -2.0
    histogram = lambda df, *by: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))

    @F.pandas_udf(T.DoubleType())
    def own(cell: pd.Series, spoken: pd.Series) -> pd.Series:
        return pd.Series([valley(_blend(dict(c), _blend(dict(s), overall, enough), enough), general - 1.5, general + 1.5) for c, s in zip(cell, spoken, strict=True)], dtype="float64")

    spoken = histogram(cells.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "lang").withColumnRenamed("h", "spoken")
    return histogram(cells, "lang", "source").join(spoken, "lang").select("lang", "source", own("h", "spoken").alias("threshold"))


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source, log_odds, is_cut) for every text that isn't blank."""
    scored = cut(score(documents))
    at = cut(thresholds(scored)).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "threshold")
    both = scored.join(at, (F.coalesce(scored.lang, F.lit("")) == F.col("t_lang")) & (F.coalesce(scored.source, F.lit("")) == F.col("t_source")))
    return both.select("doc_id", "lang", "source", "log_odds", (F.col("log_odds") < F.col("threshold")).alias("is_cut"))


def rates(detected: DataFrame) -> DataFrame:
    """How often each source cuts: n_texts, n_cut, cut_rate."""
    return detected.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("cut_rate"))
