"""Linking of the spellings of one person: typos, initials, nicknames, reordered parts.

A spelling is parsed into tokens and folded (case, accents, order, punctuation);
spellings with equal tokens are one form. Candidates come from a symmetric-delete
index on tokens: two forms meet under a key of one token as it stands, or as the
common given name one slip away from it, and another token with at most one
character deleted. Every candidate is then verified by an optimal assignment of its
tokens that permits small edits, initials and abbreviations at a cost.

Every two forms under a key are held against each other, and persons are the
components of the links. Forms with an initial or a nickname say less than a full
name; they join a person only where exactly one person fits, or exactly one that
occurs in the same context (a film).

Nicknames are not listed but learnt: a rare given name that stands for a common one
under the same surname in the same contexts, beside it in quotes, or as its beginning.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.session import cut, stage

_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_NICK = re.compile(r"[\"“”«»(]([^\"“”«»()]{2,})[\"“”«»)]|(?<=\s)['‘]([^'’]{2,})['’](?=\s)")
# What marks an element as holding markup rather than a bare name.
MARKUP = r"[<>\[\]{}\\|]|&(#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);|''|\*|^#|__|`|https?://"

PARSED = T.StructType(
    [
        T.StructField("form", T.StringType()),
        T.StructField("given", T.StringType()),
        T.StructField("surname", T.StringType()),
        T.StructField("nick", T.StringType()),
    ]
)


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in t if not unicodedata.combining(c)).translate(_FOLD)


def parse(name: str | None) -> dict | None:
    """Tokens of a spelling in the order given, middle, surname: form, given, surname, and a nickname in quotes.

    NULL, blank and letterless values give None. Initials in the middle are dropped where a full given name stands.
    """
    if not name or not name.strip():
        return None
    t = fold(name)
    nick = next((g.strip() for m in _NICK.finditer(t) for g in m.groups() if g), None)
    t = _NICK.sub(" ", t)
    head, comma, tail = t.partition(",")
    if comma and tail.strip() and not re.fullmatch(r"\s*(?:jr|sr|ii|iii|iv)\.?\s*", tail):
        t = f"{tail} {head}"
    tokens = [w.strip("'’-") for w in re.findall(r"[^\W\d_][\w'’-]*", t)]
    tokens = [w for w in tokens if w]
    if not tokens:
        return None
    if len(tokens) > 2:
        kept = [w for w in tokens[1:-1] if len(w) > 1]
        tokens = [tokens[0], *kept, tokens[-1]]
    return {"form": " ".join(tokens), "given": tokens[0] if len(tokens) > 1 else "", "surname": tokens[-1], "nick": nick}


@F.pandas_udf(PARSED)
def _parse(names: pd.Series) -> pd.DataFrame:
    empty = {"form": None, "given": None, "surname": None, "nick": None}
    return pd.DataFrame([parse(n) or empty for n in names], columns=[f.name for f in PARSED.fields])


def deletes(token: str) -> list[str]:
    """The token and what is left of it without any one of its characters (short tokens: only as it stands)."""
    if len(token) < 3:
        return [token]
    return list(dict.fromkeys([token, *(token[:i] + token[i + 1 :] for i in range(len(token)))]))


def osa(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b; most + 1 where they are more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(maxsize=100_000)  # the names of a key share tokens
def token_cost(a: str, b: str) -> float:
    """0 equal; 0.5 an initial or an abbreviation; 1 or 2 edits; 9 different."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 9.0
    short, long = sorted((a, b), key=len)
    d = osa(a, b)
    if d == 1 and len(short) >= 2 and len(long) >= 3:
        return 1.0
    if len(short) >= 3 and long.startswith(short):
        return 0.5
    return 2.0 if d == 2 and len(short) >= 7 else 9.0


def align(a: str, b: str) -> float:
    """Least total cost of assigning the tokens of a to those of b; a left-over middle token costs 0.5, more than two of
    them are different names. Tokens in common at the outer ends of long names are assigned to each other first, so that
    the search is over what differs."""
    x, y = sorted((a.split(), b.split()), key=len)
    if len(y) - len(x) > 2:
        return 9.0
    spare = 0.5 * (len(y) - len(x))
    if len(y) > 6:
        for t in list(x):
            if t in y:
                x.remove(t)
                y.remove(t)
        if len(x) > 4:
            return 9.0  # five or more different tokens are no slip
    best = {0: 0.0}
    for t in x:
        step: dict[int, float] = {}
        for used, cost in best.items():
            for k, u in enumerate(y):
                if not used >> k & 1:
                    c = cost + token_cost(t, u)
                    if c < 9 and c < step.get(used | 1 << k, 9.0):
                        step[used | 1 << k] = c
        best = step
    return min(best.values(), default=9.0) + spare


@F.pandas_udf(T.DoubleType())
def _align(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([align(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _deletes(token: str) -> Column:
    """deletes() of a column, in the JVM."""
    t = F.col(token)
    cuts = F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t))))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(F.array_distinct(F.concat(F.array(t), cuts)))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for every node that has one. Least labels spread until
    none changes.

    Every round is written to the shared folder; labels also jump to their label's label, so that the number of rounds
    grows with the logarithm of the longest chain.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component"))
    labels = cut(labels)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "component", F.least("component", "least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("further"))
        new = cut(step.join(jump, "least", "left").select("node", "component", F.least("least", "further").alias("next")))
        changed = new.where("next <> component").limit(1).count()
        labels = new.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


# What a link under a key of each kind may cost, and whether two forms with common given names can be linked by it.
KINDS = {"given": (2.0, True), "surname": (2.0, False), "middle": (1.0, False)}


# A key of more forms than this is dealt into parts of about so many, and a task gets about so many pairs; neither changes a pair.
HOT_FORMS, TASK_PAIRS = 200, 500_000


def _leader_links(keyed: DataFrame, forms: DataFrame, hot_forms: int = HOT_FORMS) -> DataFrame:
    """Verified links (a, b) of the forms under a key. keyed: key, kind, id; forms: id, form, common.

    Every two forms under a key are held against each other, not only against the most frequent one: what fits that may be
    all that a third form fits. Forms alone under their key are dropped first; the others are dealt, so that no task holds
    all pairs of a hot key, and pairs are verified where they meet, never shuffled.
    """
    most = F.create_map(*[F.lit(x) for k, (cost, _) in KINDS.items() for x in (k, cost)])[F.col("kind")]
    barred = F.col("kind").isin(*[k for k, (_, bar) in KINDS.items() if bar]) & F.col("a_common") & F.col("b_common")
    keyed = stage(keyed.select("key", "kind", "id"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(keyed.join(sizes, "key").join(forms.select("id", "form", "common"), "id").withColumn("parts", F.ceil(F.col("n") / hot_forms).cast("int")))
    tasks = max(shared.sparkSession.sparkContext.defaultParallelism, (shared.agg(F.sum("n")).collect()[0][0] or 0) // 2 // TASK_PAIRS)
    told = lambda who, part: shared.select("key", "kind", part.alias("part"), *[F.col(c).alias(f"{who}_{c}") for c in ("id", "form", "common")]).repartition(tasks, "key", "kind", "part")
    left, right = told("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), told("b", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    pairs = left.join(right, ["key", "kind", "part"]).where((F.col("a_id") < F.col("b_id")) & ~barred)
    return stage(pairs.where(_align("a_form", "b_form") <= most).select(F.col("a_form").alias("a"), F.col("b_form").alias("b")).distinct())


def _attach(vague: DataFrame, persons: DataFrame) -> DataFrame:
    """(form, person, is_only): the persons under the keys of vague forms."""
    found = vague.join(persons, "key").select("form", "person").distinct()
    count = found.groupBy("form").agg((F.count("*") == 1).alias("is_only"))
    return found.join(count, "form")


def _homes(vague: DataFrame, persons: DataFrame, said: DataFrame, members: DataFrame) -> DataFrame:
    """(form, person) of vague forms: by the surname as it stands, where no person fits so by one deletion on either side.
    Of several persons the one that alone occurs most often in the contexts of the form; none where none does.

    said: (context, form); members: (form, person) of the forms settled so far.
    """
    exact = cut(_attach(vague.where("exact"), persons.where("exact")))
    near = _attach(vague.join(exact.select("form").distinct(), "form", "left_anti"), persons)
    fits = cut(exact.unionByName(near))
    open_ = fits.where("NOT is_only").select("form", "person")
    there = said.join(open_, "form").select("context", "form", "person").distinct()
    met = there.join(said.withColumnRenamed("form", "member"), "context").join(members.select(F.col("form").alias("member"), F.col("person").alias("of")), "member").where("of = person")
    votes = cut(met.groupBy("form", "person").agg(F.count_distinct("context").alias("n")))
    top = votes.groupBy("form").agg(F.max_by("person", "n").alias("person"), F.max("n").alias("most"))
    tied = votes.join(top.select("form", "most"), "form").where("n = most").groupBy("form").agg(F.count("*").alias("k")).where("k > 1")
    return cut(fits.where("is_only").select("form", "person").unionByName(top.join(tied, "form", "left_anti").select("form", "person")))


def nicknames(said: DataFrame, parsed: DataFrame, widths: DataFrame, common: Column, share: float = 0.1, narrow: float = 0.5) -> DataFrame:
    """(short, formal) given names, learnt from the names themselves.

    said: (context, given, surname); widths: (given, width), the number of surnames of a given name. A short form is rarer
    than `narrow` of its full name (or has fewer than four surnames), and the two stand under the same surname in the same
    context for two surnames and `share` of its own at least; or it stands beside the full name in quotes; or the full
    name is common and begins with it (three letters or more). Of the given names of a surname in a context the first and
    the last by spelling are taken.
    """
    beside = said.where("length(given) > 1").groupBy("context", "surname").agg(F.min("given").alias("a"), F.max("given").alias("b")).where("a <> b").select("surname", "a", "b").distinct()
    width = lambda name: widths.select(F.col("given").alias(name), F.col("width").alias(f"{name}_width"))
    sided = beside.join(width("a"), "a").join(width("b"), "b").where("a_width <> b_width")
    first = F.col("a_width") < F.col("b_width")
    learnt = sided.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("formal"), "surname")
    learnt = learnt.groupBy("short", "formal").agg(F.count_distinct("surname").alias("seen"))
    quoted = parsed.where(F.col("nick").rlike(r"^[^\s.]{2,}$") & (F.length("given") > 1)).select(F.col("nick").alias("short"), F.col("given").alias("formal")).distinct().withColumn("seen", F.lit(None).cast("long"))
    begun = widths.where((F.length("given") > 3) & common).select(F.expr("explode(transform(sequence(3, length(given) - 1), k -> substring(given, 1, k)))").alias("short"), F.col("given").alias("formal")).withColumn("seen", F.lit(None).cast("long"))
    every = learnt.unionByName(quoted).unionByName(begun).join(width("short"), "short").join(width("formal"), "formal")
    rare = F.col("short_width") < F.greatest(F.lit(4.0), narrow * F.col("formal_width"))
    return every.where(rare & (F.col("short") != F.col("formal")) & (F.col("seen").isNull() | (F.col("seen") >= F.greatest(F.lit(2.0), share * F.col("short_width"))))).select("short", "formal").distinct()


def link_spellings(spellings: DataFrame, rare_share: float = 0.1) -> DataFrame:
    """(name, person) for a table (name, context): person is an id shared by the spellings of one person.

    context says where a name stands (a film), NULL for none. Repeated names count by their number; NULL, blank and
    letterless names are dropped. rare_share: given names whose number of surnames is below this share of the commonest
    one's (or below three) may be misspellings of others; two names above it are two names even at one edit.
    """
    known = spellings.where("name IS NOT NULL AND trim(name) <> ''")
    counted = known.groupBy("name").agg(F.count("*").alias("n"))
    # staged before it is filtered, or the filter would have every mention parsed
    parsed = stage(counted.withColumn("p", _parse("name")).select("name", F.xxhash64("name").alias("id"), "n", "p.*")).where("form IS NOT NULL")
    mentions = known.where("context IS NOT NULL AND context <> ''").select(F.xxhash64("name").alias("id"), F.xxhash64("context").alias("context"))
    said = stage(mentions.join(parsed.select("id", "form", "given", "surname"), "id").select("context", "form", "given", "surname").distinct())
    forms = parsed.groupBy("form").agg(F.sum("n").alias("n"), F.first("given").alias("given"), F.first("surname").alias("surname"))
    vague = (F.length("given") == 1) | (F.length("surname") == 1)
    widths = cut(forms.where(~vague & (F.col("given") != "")).groupBy("given").agg(F.count_distinct("surname").alias("width")))
    top = widths.agg(F.max("width")).collect()[0][0] or 0
    common = F.col("width") >= max(3.0, rare_share * top)
    pairs = cut(nicknames(said, parsed, widths, common))
    given = widths.select("given", common.alias("common")).join(pairs.select(F.col("short").alias("given"), F.lit(True).alias("short")).distinct(), "given", "left")
    forms = stage(forms.join(given, "given", "left").withColumns({"common": F.coalesce("common", F.lit(False)), "short": F.coalesce("short", F.lit(False)), "id": F.xxhash64("form")}))
    full, nicks, initials = forms.where(~vague & ~F.col("short")), forms.where(~vague & F.col("short")), forms.where(vague)

    # rare given names one slip away from a common one stand under that too
    apart = given.where("short IS NULL").withColumn("v", F.explode(_deletes("given")))
    slips = apart.where("NOT common").select("v", F.col("given").alias("slip")).join(apart.where("common").select("v", "given"), "v").select("slip", "given").distinct().where(_align("slip", "given") <= 1.0)
    also = full.join(slips.withColumnRenamed("given", "meant"), full.given == F.col("slip")).select("id", F.col("meant").alias("given"), "surname")
    keyed = lambda df, kind, keys: df.select(F.lit(kind).alias("kind"), "id", F.explode(keys).alias("key"))
    under_given = full.select("id", "given", "surname").unionByName(also)
    keys = keyed(under_given, "surname", F.transform(_deletes("surname"), lambda v: F.xxhash64(F.lit("s"), "given", v)))
    keys = keys.unionByName(keyed(full.where("given <> ''"), "given", F.transform(_deletes("given"), lambda v: F.xxhash64(F.lit("g"), "surname", v))))
    # "Mary J. Smith" and "Mary Smith" are equal forms already; here full middle names
    keys = keys.unionByName(keyed(full, "middle", F.array(F.xxhash64(F.lit("m"), "given", "surname"))))
    links = _leader_links(keys, full.select("id", "form", "common"))
    linked = components(links)
    settled = cut(full.select("form", "given", "surname").join(linked.select(F.col("node").alias("form"), F.col("component").alias("person")), "form", "left").withColumn("person", F.coalesce("person", "form")))

    def under(df: DataFrame, who: str, first: Column) -> DataFrame:
        rows = df.withColumn("v", F.explode(_deletes("surname")))
        return rows.select(who, F.xxhash64(first, "v").alias("key"), (F.col("v") == F.col("surname")).alias("exact")).distinct()

    where = said.select("context", "form").distinct()
    # nicknames: under each full name they can stand for
    nick_keys = cut(under(nicks.join(pairs.withColumnRenamed("short", "given"), "given"), "form", F.col("formal")))
    nick_home = _homes(nick_keys, under(settled, "person", F.col("given")), where, settled.select("form", "person"))
    loose = nick_keys.join(nick_home, "form", "left_anti")
    alone = loose.where("exact").groupBy("key").agg(F.min("form").alias("least")).join(loose, "key").groupBy("form").agg(F.min("least").alias("person"))
    nick_home = cut(nick_home.unionByName(alone))
    # initials: under the first letter of every given name (full or short) of a person
    members = cut(settled.unionByName(nicks.select("form", "given", "surname").join(nick_home, "form")))
    initial_keys = cut(under(initials, "form", F.substring("given", 1, 1)))
    initial_home = _homes(initial_keys, under(members.where("given <> ''"), "person", F.substring("given", 1, 1)), where, members.select("form", "person"))
    home = members.select("form", "person").unionByName(initial_home)
    rest = initials.select("form").join(initial_home.select("form"), "form", "left_anti").select("form", F.col("form").alias("person"))
    return parsed.select("name", "form").join(home.unionByName(rest), "form").select("name", "person")


def bare_names(columns: list[Column], contexts: list[Column], tables: list[DataFrame]) -> DataFrame:
    """All elements of array columns that hold no markup, with the context of their row, as a table (name, context)."""
    parts = [t.select(F.explode(c).alias("name"), k.alias("context")) for t, c, k in zip(tables, columns, contexts, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("name").isNotNull() & (F.trim("name") != "") & ~F.col("name").rlike(MARKUP))


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """All pairs (name_a < name_b) of different spellings of a person."""
    linked = stage(linked)
    a = linked.select("person", F.col("name").alias("name_a"))
    b = linked.select("person", F.col("name").alias("name_b"))
    return a.join(b, "person").where("name_a < name_b").select("name_a", "name_b")
