"""Multi-field search with boosts, filters and a small query language over linked pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Searched fields with their boosts; the usual parameters of BM25 with exact lengths.
BOOSTS = {"title": 1.5, "synopsis": 1.2, "genres_text": 1.5, "director": 1.2, "cast": 1.5, "wiki_title": 1.5}
K1, B = 1.2, 0.75


def analyse(text: Column) -> Column:
    """Words of letters and digits in lower case; accents and stop words stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def build_documents(joined: DataFrame, rt: DataFrame, min_confidence: int | None = None, max_documents: int | None = None) -> DataFrame:
    """Search documents: linked rows at or above min_confidence (unknown passes), then pages that are in none of those.

    Directors and cast fall back to the film's, the year to the film's. Rows without file_path are left out of the second
    part; one document per doc_id. max_documents keeps linked ones first, then by id (an ordered limit).
    """
    kept = joined if min_confidence is None else joined.where(F.col("join_confidence").isNull() | (F.col("join_confidence") >= min_confidence))
    only = rt.where("file_path IS NOT NULL").join(kept.select("file_path").distinct(), "file_path", "left_anti")
    texts = lambda c: F.array_join(F.col(c), ", ")
    linked = kept.select(
        F.coalesce("file_path", "wiki_page_id", "url").alias("doc_id"), "file_path", "page_type", "url", "title", "synopsis", "genres", "wiki_title",
        F.coalesce(F.nullif("director", F.lit("")), texts("wiki_directors"), F.lit("")).alias("director"), F.when(F.size("cast") > 0, F.col("cast")).otherwise(F.col("wiki_starring")).alias("cast"),
        F.coalesce(F.col("rt_year").cast("int"), "wiki_year").alias("release_year"), "tomatometer", "audience_score", F.col("wiki_runtime_minutes").alias("runtime_minutes"), "join_confidence",
    )
    alone = only.select(
        F.coalesce("file_path", "url").alias("doc_id"), "file_path", "page_type", "url", "title", "synopsis", "genres", F.lit(None).cast("string").alias("wiki_title"), F.coalesce("director", F.lit("")).alias("director"), "cast",
        F.col("rt_year").cast("int").alias("release_year"), "tomatometer", "audience_score", F.lit(None).cast("int").alias("runtime_minutes"), F.lit(None).cast("int").alias("join_confidence"),
    )
    both = linked.unionByName(alone).withColumn("genres_text", F.array_join("genres", " "))
    number, text = (lambda c: F.coalesce(c, F.lit(-1))), (lambda c: F.coalesce(c, F.lit("")))
    order = F.struct(number("join_confidence"), text("wiki_title"), number("tomatometer"), number("audience_score"), number("runtime_minutes"), number("release_year"), text("title"), text("url"))
    out = both.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in both.columns if c != "doc_id"]), order).alias("r")).select("doc_id", "r.*")
    return out.orderBy(F.col("join_confidence").isNull(), "doc_id").limit(max_documents) if max_documents else out


def field_tokens(documents: DataFrame, fields: tuple[str, ...] = tuple(BOOSTS)) -> DataFrame:
    """(doc_id, field, pos, term) of the searched fields."""
    kinds = dict(documents.dtypes)
    text = lambda f: F.array_join(F.col(f"`{f}`"), " ") if kinds[f].startswith("array") else F.col(f"`{f}`")
    per = F.array(*[F.struct(F.lit(f).alias("field"), analyse(text(f)).alias("terms")) for f in fields])
    return documents.select("doc_id", F.explode(per).alias("x")).select("doc_id", "x.field", F.posexplode("x.terms").alias("pos", "term"))


@dataclass(frozen=True)
class Clause:
    """One part of a query. words: its terms (more than one: a phrase; of a range its ends); kind: term, phrase, prefix, wild
    (* and ? anywhere), fuzzy, range (ends included where `closed` says so; '*' is no end), or group (its parts)."""

    words: tuple[str, ...]
    kind: str = "term"
    field: str | None = None
    required: bool = False
    banned: bool = False
    edits: int = 0
    boost: float = 1.0
    closed: tuple[bool, bool] = (True, True)
    parts: tuple[Clause, ...] = ()


_OPENING = re.compile(r"([+-]?)(?:(\w+):)?\(")
_RANGE = re.compile(r"([+-]?)(?:(\w+):)?([\[{])\s*(\S+)\s+TO\s+([^\s\]}]+)\s*([\]}])(?:\^(\d+(?:\.\d+)?))?")
_CLAUSE = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s()]+?))(?:\^(\d+(?:\.\d+)?))?(?=[\s()]|$)')
_BOOST = re.compile(r"\^(\d+(?:\.\d+)?)")


def parse_query(text: str) -> list[Clause]:
    """Clauses of a query: terms, "phrases", +required, -banned, field:, prefix*, w?ldc*rds, fuzzy~n, [a TO b], {a TO b},
    (groups), ^boost; AND, OR and NOT. A group that is not closed ends with the query. An unknown field is an error."""
    clauses, _ = _parse(text.strip(), 0, None, 0)
    return clauses


def _parse(text: str, at: int, outer: str | None, depth: int) -> tuple[list[Clause], int]:
    """The clauses from a place on to the end of the group (or text), and where it ends."""
    if depth > 50:
        raise ValueError("groups are nested too deeply")
    out: list[Clause] = []
    negate = together = False
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] == ")":
            return out, at + 1
        opening, span = _OPENING.match(text, at), _RANGE.match(text, at)
        if opening:
            sign, field = opening.groups()
            parts, at = _parse(text, opening.end(), _field(field) or outer, depth + 1)
            boost = _BOOST.match(text, at)
            at = boost.end() if boost else at
            made = Clause((), "group", boost=float(boost[1]) if boost else 1.0, parts=tuple(parts)) if parts else None
        elif span:
            sign, field, opens, low, high, closes, boost = span.groups()
            at = span.end()
            made = Clause((low.lower(), high.lower()), "range", _field(field) or outer, boost=float(boost or 1), closed=(opens == "[", closes == "]"))
        else:
            m = _CLAUSE.match(text, at)
            if not m:
                at += 1
                continue
            sign, field, phrase, word, boost = m.groups()
            at = m.end()
            if phrase is None and field is None and not sign and word in ("AND", "&&", "OR", "||", "NOT", "!"):
                if word in ("NOT", "!"):
                    negate = True
                elif word in ("AND", "&&"):
                    together = True
                    if out:
                        out[-1] = replace(out[-1], required=not out[-1].banned)
                continue
            made = _one(phrase, word, _field(field) or outer, float(boost or 1))
        if made:
            out.append(replace(made, required=sign == "+" or (together and not negate), banned=sign == "-" or negate))
        negate = together = False
    return out, at


def _field(name: str | None) -> str | None:
    if name and name not in BOOSTS:
        raise ValueError(f"no such field: {name}")
    return name


def _one(phrase: str | None, word: str | None, field: str | None, boost: float) -> Clause | None:
    kind, edits = "phrase", 0
    if phrase is None:
        if re.search(r"[*?].|\?$", word):
            kept = re.sub(r"[^\w*?]|_", "", word.lower())
            return Clause((kept,), "wild", field, boost=boost) if kept else None
        fuzzy = re.fullmatch(r"(.+?)~(\d?)", word)
        kind = "prefix" if word.endswith("*") else "fuzzy" if fuzzy else "term"
        edits = min(2, int(fuzzy.group(2) or 2)) if fuzzy else 0
        phrase = fuzzy.group(1) if fuzzy else word.rstrip("*")
    words = tuple(w for w in re.sub(r"[^\w]|_", " ", phrase.lower()).split() if w)
    if not words:
        return None
    if kind == "term" and len(words) > 1:
        kind = "phrase"
    return Clause(words, "term" if kind == "phrase" and len(words) == 1 else kind, field, edits=edits, boost=boost)


def _matches(tokens: DataFrame, c: Clause) -> DataFrame:
    """(doc_id, field, key, tf) of a clause's matches; a phrase counts where its words follow each other."""
    t = tokens.where(F.col("field") == c.field) if c.field else tokens
    if c.kind == "phrase":
        # every word votes for the place where the phrase would begin
        at = F.coalesce(*[F.when(F.col("term") == w, F.lit(1)) for w in c.words])
        votes = t.where(at.isNotNull()).select(
            "doc_id", "field", F.explode(F.filter(F.array(*[F.when(F.col("term") == w, F.struct((F.col("pos") - i).alias("start"), F.lit(i).alias("i"))) for i, w in enumerate(c.words)]), lambda x: x.isNotNull())).alias("v")
        )
        found = votes.groupBy("doc_id", "field", "v.start").agg(F.count_distinct("v.i").alias("n")).where(F.col("n") == len(c.words))
        return found.groupBy("doc_id", "field").agg(F.count("*").alias("tf")).withColumn("key", F.lit(" ".join(c.words)))
    w = c.words[0]
    if c.kind == "fuzzy":  # the edit distance to every distinct term, not to every place of one
        terms = t.select("term").distinct().where(F.levenshtein("term", F.lit(w), c.edits) >= 0)
        return t.join(terms, "term", "left_semi").groupBy("doc_id", "field", F.col("term").alias("key")).agg(F.count("*").alias("tf"))
    hit = {"term": F.col("term") == w, "prefix": F.col("term").startswith(w), "wild": F.col("term").rlike("^" + re.escape(w).replace(r"\*", ".*").replace(r"\?", ".") + r"\z"), "range": _within(c)}[c.kind]
    key = F.col("term") if c.kind == "term" else F.lit(" TO ".join(c.words))
    return t.where(hit).groupBy("doc_id", "field", key.alias("key")).agg(F.count("*").alias("tf"))


def _within(c: Clause) -> Column:
    """Whether a term lies in the range of a clause, by code points."""
    if c.kind != "range":
        return F.lit(False)
    (low, high), t = c.words, F.col("term")
    above = F.lit(True) if low == "*" else t >= low if c.closed[0] else t > low
    return above & (F.lit(True) if high == "*" else t <= high if c.closed[1] else t < high)


def _word_matches(tokens: DataFrame, words: list[Clause]) -> DataFrame:
    """(doc_id, field, key, tf, weight) of all single-word clauses in one pass; weights of clauses for one word add up."""
    rows = [(c.words[0], f, (sum(BOOSTS.values()) if c.field else BOOSTS[f]) * c.boost) for c in words for f in BOOSTS if c.field in (None, f)]
    table = tokens.sparkSession.createDataFrame(rows, "term string, field string, w double").groupBy("term", "field").agg(F.sum("w").alias("weight"))
    hits = tokens.join(F.broadcast(table), ["term", "field"])  # as many rows as the query has words and fields
    return hits.groupBy("doc_id", "field", F.col("term").alias("key")).agg(F.count("*").alias("tf"), F.first("weight").alias("weight"))


def passes(page_type: str | None = None, years: tuple[int, int] | None = None, min_tomatometer: int | None = None, min_audience: int | None = None, min_confidence: int | None = None) -> Column:
    """The filters of a search, none of which scores; a document without the field fails."""
    keep = F.lit(True)
    if page_type:
        keep = keep & (F.col("page_type") == page_type)
    if years:
        keep = keep & F.col("release_year").between(*years)
    for name, least, most in (("tomatometer", min_tomatometer, 100), ("audience_score", min_audience, 100), ("join_confidence", min_confidence, 10)):
        if least is not None:
            keep = keep & F.col(name).between(least, most)
    return F.coalesce(keep, F.lit(False))


def search(documents: DataFrame, query: str, where: Column | None = None, k: int = 10, tokens: DataFrame | None = None) -> DataFrame:
    """The best k documents with their fields and score (6 digits; ties by doc_id).

    Per field: BM25 with exact lengths and idf ln(1 + (n - df + .5) / (df + .5)), over the documents that have the field;
    the sum over clauses and fields, times the boosts. Clauses are alternatives but for + and -. A clause of one field
    counts with the sum of all boosts, as it is read once for every searched field. An empty query has no hits.
    """
    tokens = field_tokens(documents) if tokens is None else tokens
    lengths = tokens.groupBy("doc_id", "field").agg(F.count("*").alias("dl"))
    stats = lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    scored = _scores(tokens, parse_query(query), lengths, stats)
    if scored is None:
        scored = documents.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    totals = scored.withColumn("score", F.round("score", 6))
    shown = documents.where(where) if where is not None else documents
    fields = ["doc_id", "title", "page_type", "url", "file_path", "score", "release_year", "tomatometer", "audience_score", "runtime_minutes", "join_confidence", "genres", "cast"]
    return totals.join(shown, "doc_id").select(*fields).orderBy(F.desc("score"), "doc_id").limit(k)


def _scores(tokens: DataFrame, clauses: list[Clause], lengths: DataFrame, stats: DataFrame) -> DataFrame | None:
    """(doc_id, score) of the documents that a list of clauses finds; None for a list that finds nothing. A group is a
    query of its own, whose scores count with its boost."""
    boost = F.create_map(*[x for f, w in BOOSTS.items() for x in (F.lit(f), F.lit(w))])
    scored: DataFrame | None = None
    required, banned = [], []
    words = [c for c in clauses if c.kind == "term" and not c.banned]
    groups = [_word_matches(tokens, words)] if words else []
    for c in clauses:
        inner = _scores(tokens, list(c.parts), lengths, stats) if c.kind == "group" else None
        if c.kind == "group" and inner is None:
            continue
        if c.required or c.banned:
            (banned if c.banned else required).append((inner if c.kind == "group" else _matches(tokens, c)).select("doc_id").distinct())
        if c.banned or c.kind == "term":
            continue
        if c.kind == "group":
            rows = inner.select("doc_id", (F.col("score") * c.boost).alias("part"))
            scored = rows if scored is None else scored.unionByName(rows)
        else:
            weight = F.lit(sum(BOOSTS.values())) if c.field else boost[F.col("field")]
            groups.append(_matches(tokens, c).withColumn("weight", weight * c.boost))
    for hits in groups:
        df = hits.groupBy("field", "key").agg(F.count_distinct("doc_id").alias("df"))
        part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("weight")
        rows = hits.join(df, ["field", "key"]).join(F.broadcast(stats), "field").join(lengths, ["doc_id", "field"]).select("doc_id", part.alias("part"))  # stats: a row per field
        scored = rows if scored is None else scored.unionByName(rows)
    if scored is None:
        return None
    totals = scored.groupBy("doc_id").agg(F.sum("part").alias("score"))
    for r in required:
        totals = totals.join(r, "doc_id", "left_semi")
    for b in banned:
        totals = totals.join(b, "doc_id", "left_anti")
    return totals
