"""Segmentation lattices over strings that may pack several values (worker-side Python)."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

from filmloom.functions.bits import may_hold

SHORT = 4

# The marks and words that can separate values, and how probable a split at each is before the values are looked at.
SPLIT_PRIOR = {"\n": 0.98, "\t": 0.9, "|": 0.98, ";": 0.98, "·": 0.98, "•": 0.98, "/": 0.9, ",": 0.6, "&": 0.7, "word": 0.6, ",word": 0.9, "+": 0.7}
NEW, RARE = "new", "rare"

_DELIMITER = re.compile(r"\s*,\s*(?:and|und|et|y|e|&)\s+|\s*[\n\r]+\s*|\s*[|;·•,/&\t+]\s*|\s+(?:and|und|et|y)\s+")
_QUOTED = re.compile(r'(?<![^\s|;·•,/&+])"([^"]*)"(?![^\s|;·•,/&+])|“([^”]*)”|«([^»]*)»')


def _kind(delimiter: str) -> str:
    if "\n" in delimiter or "\r" in delimiter:
        return "\n"
    d = delimiter.strip()
    if d in SPLIT_PRIOR:
        return d
    if d.startswith(","):
        return ",word"
    return "word" if d else "\t"


@lru_cache(maxsize=50_000)
def pieces(text: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[bool, ...], tuple[str, ...]]:
    """Pieces between delimiters, the delimiters, which pieces are quoted (atomic), and the delimiters' kinds.

    Delimiters within a quoted span do not count. Empty pieces are dropped with the delimiter before them.
    """
    spans = [(m.start(), m.end()) for m in _QUOTED.finditer(text)]
    cuts, at = [], 0
    while True:
        m = _DELIMITER.search(text, at)
        if not m:
            break
        inside = next((b for a, b in spans if m.start() < b and a < m.end()), None)
        if inside is not None:
            at = inside if inside > m.start() else m.end()
            continue
        cuts.append((m.start(), m.end()))
        at = m.end()
    parts, marks, start, mark = [], [], 0, ""
    for a, b in [*cuts, (len(text), len(text))]:
        piece = text[start:a].strip()
        if piece:
            if parts:
                marks.append(mark)
            parts.append(piece)
            mark = text[a:b]
        elif parts and _kind(text[a:b]) != "word":
            mark = mark if _kind(mark) == "\n" else text[a:b]
        start = b
    quoted, clean = [], []
    for p in parts:
        m = _QUOTED.fullmatch(p)
        quoted.append(bool(m))
        clean.append(next(g for g in m.groups() if g is not None).strip() if m else p)
    return tuple(clean), tuple(marks), tuple(quoted), tuple(_kind(m) for m in marks)


@lru_cache(maxsize=20_000)
def _laid_out(text: str) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    """The pieces with their delimiters as one string, and where each piece begins and ends in it."""
    parts, marks, _, _ = pieces(text)
    out, starts, ends, at = [], [], [], 0
    for k, part in enumerate(parts):
        if k:
            m = marks[k - 1]
            mark = " " if "\n" in m else m if m.strip() else " "
            out.append(mark)
            at += len(mark)
        starts.append(at)
        out.append(part)
        at += len(part)
        ends.append(at)
    return "".join(out), tuple(starts), tuple(ends)


def segment(text: str, i: int, j: int) -> str | None:
    """The value made of pieces i..j-1 as written, or None where a quoted piece would be joined with others."""
    if j - i > 1 and any(pieces(text)[2][i:j]):
        return None
    line, starts, ends = _laid_out(text)
    return line[starts[i] : ends[j - 1]]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _prefix_hashes(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Wrapping sums of the characters times powers of a base, and the inverse powers: any segment's hash is a difference."""
    chars = np.frombuffer(line.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars), _BASE)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars), _INVERSE)]), dtype=np.uint64)
        return np.concatenate([[np.uint64(0)], np.cumsum(chars * powers[:-1], dtype=np.uint64)]), back


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def whole_key(text: str) -> int | None:
    """A 64-bit key of a string of more than SHORT pieces, none quoted; None for others."""
    parts, _, quoted, _ = pieces(text)
    if len(parts) <= SHORT or any(quoted):
        return None
    return int(_mixed(_prefix_hashes(_laid_out(text)[0])[0][-1:]).view(np.int64)[0])


def candidates(text: str, wholes: np.ndarray | None = None) -> list[str]:
    """What can be a value of text: every run of up to SHORT pieces, the whole, and longer runs that may be a whole string of
    the column (by the bit field of their keys)."""
    parts, _, quoted, _ = pieces(text)
    n = len(parts)
    spans = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + SHORT) + 1)]
    if n > SHORT:
        spans.append((0, n))
    found = [segment(text, i, j) for i, j in spans]
    if wholes is not None and n > SHORT + 1:
        line, starts, ends = _laid_out(text)
        sums, back = _prefix_hashes(line)
        at_ends = np.array(ends)
        limit = n
        for i in range(n - 1, -1, -1):
            limit = i if quoted[i] else limit
            if limit - i > SHORT:
                with np.errstate(over="ignore"):
                    keys = _mixed((sums[at_ends[i + SHORT : limit]] - sums[starts[i]]) * back[starts[i]])
                found += [line[starts[i] : ends[i + SHORT + k]] for k in np.flatnonzero(may_hold(wholes, keys)).tolist()]
    return list(dict.fromkeys(s for s in found if s))


def _spans(text: str, values) -> list[tuple[int, int]]:
    """The runs of pieces to weigh, by their beginning: short ones and the places of the longer candidates."""
    parts = pieces(text)[0]
    n = len(parts)
    out = {(i, j) for i in range(n) for j in range(i + 1, min(n, i + SHORT) + 1)}
    if n > SHORT:
        out.add((0, n))
        line, starts, ends = _laid_out(text)
        first, last = {a: i for i, a in enumerate(starts)}, {b: j for j, b in enumerate(ends)}
        for v in values:
            if len(v) > 2 * SHORT and len(pieces(v)[0]) > SHORT:
                at = line.find(v)
                while at >= 0:
                    if at in first and at + len(v) in last:
                        out.add((first[at], last[at + len(v)] + 1))
                    at = line.find(v, at + 1)
    return sorted(out)


def shape(value: str) -> str:
    """Word count (to 5) and the kinds of delimiters inside: what tells a plausible value from a torn one."""
    inner = sorted({_kind(m.group(0)) for m in _DELIMITER.finditer(value)})
    words = len(re.findall(r"\w[\w.'’-]*", value))
    return f"{min(words, 5)}{'.' if value.endswith('.') and words == 1 else ''}{' '.join(inner)}"


def value_logp(value: str, count: float, total: float, shapes: dict[str, float]) -> float:
    """Log of the share of a value: how often it itself occurs, plus what a new value of its shape may expect.

    shapes holds the share of each shape, under NEW the share of values that occur once (what to expect of unseen ones)
    and under RARE the share of a shape never seen.
    """
    new = shapes.get(NEW, 0.5) * shapes.get(shape(value), shapes.get(RARE, 1e-4))
    return math.log(count / max(total, 1.0) + new + 1e-300)


def _edges(text: str, counts: dict[str, float], total: float, shapes: dict[str, float]):
    parts, _, _, kinds = pieces(text)
    n = len(parts)
    for i, j in _spans(text, counts):
        s = segment(text, i, j)
        if not s:
            continue
        lp = value_logp(s, counts.get(s, 0.0), total, shapes)
        lp += sum(math.log(1 - SPLIT_PRIOR[kinds[k]]) for k in range(i, j - 1))
        if j < n:
            lp += math.log(SPLIT_PRIOR[kinds[j - 1]])
        yield i, j, s, lp


def _add(a: float, b: float) -> float:
    if a == -math.inf:
        return b
    if b == -math.inf:
        return a
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def expected(text: str, counts: dict[str, float], total: float, shapes: dict[str, float]) -> tuple[dict[str, float], float]:
    """Expected number of times each candidate is a value of text, and the text's log-likelihood (forward-backward over the
    lattice)."""
    n = len(pieces(text)[0])
    edges = list(_edges(text, counts, total, shapes))
    fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    fwd[0], bwd[n] = 0.0, 0.0
    for i, j, _, lp in edges:  # ordered by i
        fwd[j] = _add(fwd[j], fwd[i] + lp)
    for i, j, _, lp in reversed(edges):
        bwd[i] = _add(bwd[i], bwd[j] + lp)
    out: dict[str, float] = {}
    for i, j, s, lp in edges:
        p = math.exp(min(0.0, fwd[i] + lp + bwd[j] - fwd[n]))
        if p > 1e-6:
            out[s] = out.get(s, 0.0) + p
    return out, fwd[n]


def viterbi(text: str, counts: dict[str, float], total: float, shapes: dict[str, float]) -> list[str]:
    """The values of the most probable segmentation, in order."""
    n = len(pieces(text)[0])
    best: list[tuple[float, int, str]] = [(-math.inf, 0, "")] * (n + 1)
    best[0] = (0.0, 0, "")
    for i, j, s, lp in _edges(text, counts, total, shapes):
        if best[i][0] + lp > best[j][0]:
            best[j] = (best[i][0] + lp, i, s)
    out, at = [], n
    while at > 0:
        _, i, s = best[at]
        out.append(s)
        at = i
    return out[::-1]
