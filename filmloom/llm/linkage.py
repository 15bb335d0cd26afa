"""Probabilistic linkage of records of two tables that share no key.

Several blocking passes propose pairs (equal titles without spaces; titles equal
but for one word). Pairs are compared field by field on agreement levels. The
probabilities of each level among matches and among non-matches are estimated by
expectation-maximisation over the counts of agreement patterns, of which there
are few however many pairs there are; the posterior of a pair's pattern is its
confidence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.session import stage

# Latin letters with marks and what they fold to, and words that carry no weight in a title.
_FOLDS = {
    "a": "áàâäãåāă", "c": "çćč", "d": "ďđ", "e": "éèêëēęě", "g": "ğ", "i": "íìîïīı", "l": "ł", "n": "ńňñ", "o": "óòôöõøōő",
    "r": "ř", "s": "śšşß", "t": "ťţ", "u": "úùûüūůű", "y": "ýÿ", "z": "źżž",
}
_MARKED = "".join(_FOLDS.values())
_FOLDED = "".join(k * len(v) for k, v in _FOLDS.items())
SMALL_WORDS = ("the", "a", "an", "of", "and", "in", "to", "le", "la", "les", "el", "los", "der", "die", "das", "de")
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
HOT_PAGES = 50
FIELDS = ("title", "year", "director", "cast", "runtime")
LEVELS = {"title": 4, "year": 3, "director": 3, "cast": 3, "runtime": 3}
THRESHOLD = 0.5


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), _MARKED, _FOLDED)


def _plain_title(title: Column) -> Column:
    """A title without qualifiers in brackets, case and marks; a colon stays."""
    t = F.regexp_replace(fold(title), r"\s*[\[({][^\])}]*[\])}]\s*", " ")
    return F.regexp_replace(F.regexp_replace(t, "&+", " and "), r"['’`]", "")


def _word_list(words: Column) -> Column:
    """Words of a string of words without articles at either end; numerals as digits. A first word that is one slip away
    from "the" counts as one."""
    first = F.substring_index(words, " ", 1)
    slipped = (F.length(first).between(2, 4) & (F.levenshtein(first, F.lit("the"), 1) >= 0) | first.isin("teh", "hte")) & words.contains(" ")
    parts = F.filter(F.split(F.when(slipped, F.substr(words, F.length(first) + 2)).otherwise(words), " "), lambda w: w != "")
    numerals = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.transform(parts, lambda w: F.coalesce(numerals[w], w))
    return F.when(words.rlike(r"(?:^| )[ivx]+(?: |$)"), digits).otherwise(parts)


def with_title_columns(df: DataFrame, title: Column) -> DataFrame:
    """df with words, whole and main of a title, step by step, so that no step is evaluated for each that follows it.

    words: without qualifiers in brackets, marks, case and articles at either end, numerals as digits. A title without any
    Latin letter or digit keeps its own letters. whole: its letters and digits with its article and without spaces, which a
    misplaced space leaves as they are. main: the words before the first colon as one; NULL without a colon.
    """
    edge = lambda c: F.regexp_replace(c, r"^(the|a|an) (?=\S)|(?<=\S) (the|a|an)$", "")
    spaced = lambda c: F.trim(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]+", " "))
    df = df.withColumn("__plain", _plain_title(title))
    df = df.withColumns({"__spaced": spaced(F.col("__plain")), "__colon": F.when(F.col("__plain").contains(":"), edge(spaced(F.substring_index("__plain", ":", 1))))})
    df = df.withColumns({"__edged": edge(F.col("__spaced")), "whole": F.replace("__spaced", F.lit(" "), F.lit(""))})
    return df.withColumns({"words": _word_list(F.col("__edged")), "main": F.when(F.col("__colon").isNotNull(), F.array_join(_word_list(F.col("__colon")), ""))}).drop("__plain", "__spaced", "__colon", "__edged")


def people_tokens(text: Column) -> Column:
    """Distinct words of three letters or more in the names of a field, as 32-bit hashes: what pairs carry is small, and a
    clash of two words in one pair is a matter of one in many millions."""
    words = F.filter(F.split(F.regexp_replace(fold(text), r"(?U)<[^>]*>|&\w+;|[^\p{L}]+", " "), " "), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(words, lambda w: F.hash(w)))


def _skip_keys(words: Column) -> Column:
    """One key for every word left out: its place and the other words' hashes folded into one. Where fewer than two words
    with weight remain, the left-out word stays in the key with one character deleted (and as it stands), so that no key
    is as common as a single word."""
    light = lambda w: w.isin(*SMALL_WORDS)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    every = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))
    weight = F.size(F.filter(words, lambda w: ~light(w)))
    told = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def without(x: Column) -> Column:
        w, rest = x["w"], every.bitwiseXOR(F.xxhash64(x["w"]))
        cuts = F.transform(F.sequence(F.lit(0), F.length(w)), lambda k: F.xxhash64(rest, x["i"], F.concat(F.substring(w, F.lit(1), k), F.substring(w, k + 2, F.length(w)))))
        return F.when(weight - F.when(light(w), 0).otherwise(1) >= 2, F.array(F.xxhash64(rest, x["i"]))).otherwise(cuts)

    return F.flatten(F.transform(told, without))


def _year_of(*texts: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*texts), lambda y: y.isNotNull()))


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<!\d)((?:18|19|20)\d{2})(?!\d)", 1), F.lit("")).try_cast("int")


def _one_year(years: Column) -> Column:
    """The year where there is one, 0 where there is none or more than one: a key's year, compatible with any if 0."""
    return F.when(F.size(years) == 1, years[0]).otherwise(0)


def left_records(rt: DataFrame) -> DataFrame:
    """Per row: id (the page), words, whole, main, years, directors, cast, runtime. Rows without a page are left out.

    Repeated rows of a page stay: they meet the same partners, and the page counts once in the result.
    """
    hours = F.coalesce(F.nullif(F.regexp_extract("runtime", r"(\d+)\s*h", 1), F.lit("")).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.nullif(F.regexp_extract("runtime", r"(\d+)\s*m", 1), F.lit("")).try_cast("int"), F.lit(0))
    return with_title_columns(rt.where("file_path IS NOT NULL"), F.coalesce("title", F.lit(""))).select(
        F.col("file_path").alias("id"),
        "words",
        "whole",
        "main",
        _year_of(F.col("rt_year").cast("int"), year_in(F.col("release_date"))).alias("years"),
        people_tokens(F.coalesce("director", F.lit(""))).alias("directors"),
        people_tokens(F.coalesce(F.array_join("cast", " "), F.lit(""))).alias("cast"),
        F.nullif(hours * 60 + minutes, F.lit(0)).alias("runtime"),
    )


def right_records(wiki: DataFrame) -> DataFrame:
    """Per page the same fields as in left_records, but for its titles. Rows of a page that lack only the runtime count
    with the others."""
    one = wiki.where("wiki_page_id IS NOT NULL").groupBy("wiki_page_id", "wiki_year", year_in(F.col("wiki_released_raw")).alias("raw"), "wiki_directors", "wiki_starring")
    return one.agg(F.max("wiki_runtime_minutes").alias("runtime")).select(
        F.col("wiki_page_id").alias("id"),
        _year_of(F.col("wiki_year").cast("int"), F.col("raw")).alias("years"),
        people_tokens(F.coalesce(F.array_join("wiki_directors", " "), F.lit(""))).alias("directors"),
        people_tokens(F.coalesce(F.array_join("wiki_starring", " "), F.lit(""))).alias("cast"),
        "runtime",
    )


def page_titles(wiki: DataFrame, redirect: DataFrame) -> DataFrame:
    """(id, words, whole, main, year): the titles of all rows of a page and of the redirects to any of them."""
    year = _one_year(_year_of(F.col("wiki_year").cast("int"), year_in(F.col("wiki_released_raw"))))
    own = wiki.where("wiki_page_id IS NOT NULL AND wiki_title IS NOT NULL").select(F.col("wiki_page_id").alias("id"), F.col("wiki_title").alias("title"), "wiki_title_norm", year.alias("year")).distinct()
    # A redirect names its target by the normalised title, or, where that is empty, as it stands.
    target = lambda norm, plain: F.when(F.col(norm) != "", F.col(norm)).otherwise(F.concat(F.lit("="), F.col(plain)))
    other = redirect.where("redirect_title IS NOT NULL").select("redirect_title", target("target_title_norm", "target_title").alias("t")).distinct()
    through = own.select("id", "year", target("wiki_title_norm", "title").alias("t")).join(other, "t").select("id", F.col("redirect_title").alias("title"), "year")
    return with_title_columns(own.select("id", "title", "year").unionByName(through), F.col("title")).select("id", "words", "whole", "main", "year")


def _keys(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
    """(name, key, year): the words joined, all letters with the article, the main title for the other's whole and the
    whole for the other's main title, and, with the year, the words but one. Keys are hashes; a clash costs one
    comparison."""
    light = F.filter("words", lambda w: ~w.isin("a", "an", "the"))
    told = df.where("size(words) > 0").withColumn("joined", F.array_join(F.when(F.size(light) > 0, light).otherwise(F.col("words")), ""))
    few = F.when(F.size("words") > 1, _skip_keys(F.col("words"))).otherwise(F.array().cast("array<long>"))
    plain = F.array(*[F.when(F.length(k) > 1, F.xxhash64(k)) for k in (F.concat(F.lit("="), "joined"), F.concat(F.lit("w"), "whole"), F.concat(F.lit(own), "main"), F.concat(F.lit(other), "joined"))])
    return told.select(name, "year", F.explode(F.array_distinct(F.concat(F.transform(F.array_compact(plain), lambda k: F.struct(k.alias("key"), F.lit(False).alias("dated"))), F.transform(few, lambda k: F.struct(k.alias("key"), F.lit(True).alias("dated")))))).alias("k")).select(
        name, "k.key", F.when(F.col("k.dated"), F.col("year")).otherwise(0).alias("year")
    )


def candidate_pairs(left: DataFrame, right: DataFrame, titles: DataFrame, hot_pages: int = HOT_PAGES) -> DataFrame:
    """Distinct (left_id, right_id) that meet in a blocking pass. left has `left_id`, right and titles `right_id`.

    Passes: equal words, equal letters (a misplaced space), one's whole title before the other's colon, all words but
    one with years at most one apart (or unknown on a side). Every pair under a key is met; a key that more than
    hot_pages title rows share is dealt into parts of about so many, so that no task holds all of it. Records without
    any title word are left out.
    """
    l_keys, r_keys = _keys(left, "left_id", "n", "m"), stage(_keys(titles, "right_id", "m", "n").distinct())
    hot = stage(r_keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_pages).select("key", F.ceil(F.col("n") / hot_pages).cast("int").alias("parts")))
    r_parts = r_keys.join(hot, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("right_id"), "parts").cast("int"), F.lit(0)).alias("part"), "right_id", F.col("year").alias("other"))
    l_parts = l_keys.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))).alias("part"), "left_id", "year")
    both = l_parts.join(r_parts, ["key", "part"])
    return both.where((F.col("year") == 0) | (F.col("other") == 0) | (F.abs(F.col("year") - F.col("other")) <= 1)).select("left_id", "right_id").distinct()


def _overlap(a: str, b: str) -> Column:
    """2 at least two name words in common, 1 one, 0 none, -1 where a side is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1)).otherwise(F.least(n, F.lit(2)))


def compare(pairs: DataFrame, left: DataFrame, right: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs with an agreement level per field; -1 where a side has no value. The best of a page's titles counts."""
    l = left.select("left_id", F.array_join("words", " ").alias("l_title"), *[F.col(c).alias(f"l_{c}") for c in ("years", "directors", "cast", "runtime")])
    r = right.select("right_id", *[F.col(c).alias(f"r_{c}") for c in ("years", "directors", "cast", "runtime")])
    t = titles.select("right_id", F.array_join("words", " ").alias("r_title")).distinct()
    both = pairs.join(l, "left_id").join(t, "right_id").join(r, "right_id")
    whole, other = F.replace("l_title", F.lit(" "), F.lit("")), F.replace("r_title", F.lit(" "), F.lit(""))
    d = F.levenshtein(whole, other, 2)
    title = F.when(whole == other, 3).when(d >= 0, 2).when(F.size(F.array_except(F.split("l_title", " "), F.split("r_title", " "))) <= 1, 1).otherwise(0)
    gap = F.array_min(F.flatten(F.transform("l_years", lambda a: F.transform("r_years", lambda b: F.abs(a - b)))))
    run = F.abs(F.col("l_runtime") - F.col("r_runtime"))
    levels = both.select(
        "left_id",
        "right_id",
        title.alias("title"),
        F.when(gap.isNull(), -1).when(gap == 0, 2).when(gap == 1, 1).otherwise(0).alias("year"),
        _overlap("l_directors", "r_directors").alias("director"),
        _overlap("l_cast", "r_cast").alias("cast"),
        F.when(run.isNull(), -1).when(run <= 2, 2).when(run <= 10, 1).otherwise(0).alias("runtime"),
    )
    return levels.groupBy("left_id", "right_id").agg(*[F.max(f).alias(f) for f in FIELDS])


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = 100) -> tuple[dict[tuple[int, ...], float], dict]:
    """Posterior probability of a match for each agreement pattern, and the fitted model, by expectation-maximisation.

    Fields count as independent given match or non-match; a missing field says nothing. Starts from agreement being
    likely among matches, and keeps a small count at every level so that no probability is zero.
    """
    if not patterns:
        return {}, {"prior": 0.0, "m": {}, "u": {}}
    x = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    m, u = [], []
    for k, f in enumerate(FIELDS):
        top = LEVELS[f]
        up = np.arange(1, top + 1, dtype=float) ** 3
        m.append(up / up.sum())
        seen = np.array([n[x[:, k] == v].sum() for v in range(top)]) + 1.0
        down = up[::-1] / up.sum() * 0.5 + 0.5 * seen / seen.sum()
        u.append(down / down.sum())
    prior = 0.3
    post = np.zeros(len(n))
    for _ in range(iterations):
        score = np.full(len(n), np.log(prior) - np.log1p(-prior))
        for k in range(len(FIELDS)):
            have = x[:, k] >= 0
            v = np.where(have, x[:, k], 0)
            score += np.where(have, np.log(m[k][v]) - np.log(u[k][v]), 0.0)
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        prior = float(np.clip((post * n).sum() / n.sum(), 1e-4, 1 - 1e-4))
        for k, f in enumerate(FIELDS):
            for table, w in ((m, post * n), (u, (1 - post) * n)):
                c = np.array([w[x[:, k] == v].sum() for v in range(LEVELS[f])]) + 0.5
                table[k] = c / c.sum()
    return {tuple(int(v) for v in p): float(q) for p, q in zip(x, post, strict=True)}, {"prior": prior, "m": dict(zip(FIELDS, m, strict=True)), "u": dict(zip(FIELDS, u, strict=True))}


def link(rt: DataFrame, wiki: DataFrame, redirect: DataFrame) -> DataFrame:
    """All candidate pairs (file_path, right_id) with their levels and `confidence` (posterior of a match).

    Empty tables give no rows. Records are staged once, narrow and under a short id.
    """
    spark = rt.sparkSession
    left = stage(left_records(rt).withColumn("year", _one_year(F.col("years"))).withColumn("left_id", F.monotonically_increasing_id()))
    right = stage(right_records(wiki).withColumnRenamed("id", "right_id"))
    titles = stage(page_titles(wiki, redirect).withColumnRenamed("id", "right_id"))
    levels = stage(compare(candidate_pairs(left, right, titles), left, right, titles))
    counted = levels.groupBy(*FIELDS).count().collect()  # at most the product of the levels: a few hundred rows
    post, _ = fit([(tuple(r[f] for f in FIELDS), r["count"]) for r in counted])
    schema = ", ".join(f"{f} int" for f in FIELDS) + ", confidence double"
    table = spark.createDataFrame([(*p, c) for p, c in sorted(post.items())], schema)
    scored = levels.join(F.broadcast(table), list(FIELDS))
    return scored.join(left.select("left_id", F.col("id").alias("file_path")), "left_id").drop("left_id")


def best_matches(linked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each page the right record of highest confidence, from threshold on; ties by agreement, then id."""
    agree = sum((F.greatest(F.col(f), F.lit(0)) for f in FIELDS), F.lit(0))
    top = linked.where(F.col("confidence") >= threshold).groupBy("file_path").agg(
        F.max_by(F.struct("right_id", "confidence"), F.struct("confidence", agree, "title", "director", "year", "right_id")).alias("b")
    )
    return top.select("file_path", F.col("b.right_id").alias("wiki_page_id"), "b.confidence")
