"""Mixing of sources to target shares of the total size, with capped repetition.

Texts are aggregated by membership pattern (the set of sources a text occurs in);
a minimum-cost flow routes the patterns' tokens to the sources' quotas, at a cost
that grows with every further repetition, so that nothing is repeated while fresh
text is left. The flow is solved on patterns, of which there are few; the texts
themselves are chosen by a seeded order, distributed, by where they lie on a
running total of tokens.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from filmloom.llm.tokens import VOCABULARY, fingerprint, measure
from filmloom.session import stage

SEED = 20
BUCKET_TEXTS = 20_000
MOST_TARGETS = 1000
MOST_PATTERNS = 100_000


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; integer capacities."""

    def __init__(self, n: int):
        self.edges: list[list] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, s: int, t: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            far[s], via = 0, [-1] * n
            queue = [(0, s)]
            while queue:
                d, a = heapq.heappop(queue)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    b, capacity, cost = self.edges[e]
                    x = d + cost + potential[a] - potential[b]
                    if capacity > 0 and x < far[b]:
                        far[b], via[b] = x, e
                        heapq.heappush(queue, (x, b))
            if far[t] == float("inf"):
                return total
            for v in range(n):
                if far[v] < float("inf"):
                    potential[v] += int(far[v])
            amount, v = None, t
            while v != s:
                e = via[v]
                amount = self.edges[e][1] if amount is None else min(amount, self.edges[e][1])
                v = self.edges[e ^ 1][0]
            v = t
            while v != s:
                self.edges[via[v]][1] -= amount
                self.edges[via[v] ^ 1][1] += amount
                v = self.edges[via[v] ^ 1][0]
            total += amount


def solve(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens to take from each pattern for each source. patterns: tokens of the distinct texts of a set of sources;
    targets: share and most repetitions of a source.

    A pattern's k-th repetition costs k squared; no pattern is used more often than the most any of its sources allows, nor
    for one source more often than that source allows.
    """
    names = sorted(targets)
    sets = sorted(p for p in patterns if any(s in targets for s in p))
    node = {x: i + 2 for i, x in enumerate([*sets, *names])}
    flow, arcs = Flow(len(node) + 2), {}
    for p in sets:
        most = max(targets[s][1] for s in p if s in targets)
        for k in range(most):
            flow.add(0, node[p], patterns[p], k * k)
        for s in p:
            if s in targets:
                arcs[p, s] = flow.add(node[p], node[s], patterns[p] * targets[s][1], 0)
    for s in names:
        flow.add(node[s], 1, round(targets[s][0] * total), 0)
    flow.run(0, 1)
    return {a: flow.edges[e ^ 1][1] for a, e in arcs.items() if flow.edges[e ^ 1][1] > 0}


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and most repetitions of each source. The table is small and does not grow; more than MOST_TARGETS rows are an
    error."""
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return {r.source: (float(r.target_share or 0), int(r.max_repeats or 1)) for r in rows}


def distinct_texts(documents: DataFrame, wanted: list[str], path: str = VOCABULARY) -> DataFrame:
    """(text_id, members, n_tokens, all_tokens, sources): every distinct text with the wanted sources it occurs in and, per
    source, its least document id. Other sources are folded into none: they count in all_tokens only, so that patterns
    are sets of wanted sources. Texts without tokens and rows without a source are left out."""
    known = documents.select("doc_id", "source", "text", fingerprint().alias("text_id")).where("text IS NOT NULL AND source IS NOT NULL")
    known = known.withColumn("source", F.when(F.col("source").isin(wanted), F.col("source")))
    sized = measure(known, ["doc_id", "source", "text_id"], path)
    per = sized.where("n_tokens > 0").groupBy("text_id", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.count("*").alias("copies"))
    return per.groupBy("text_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "doc_id")))).alias("members"), F.max("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens")
    ).withColumn("sources", F.col("members.source"))


def plan(texts: DataFrame, wanted: dict[str, tuple[float, int]]) -> tuple[dict, dict, int]:
    """(flow, patterns, total size). Patterns are sets of wanted sources; more than MOST_PATTERNS are an error."""
    rows = texts.groupBy("sources").agg(F.sum("n_tokens").alias("t"), F.sum("all_tokens").alias("a")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    patterns = {tuple(r.sources): int(r.t) for r in rows}
    total = sum(int(r.a) for r in rows)
    return solve(patterns, wanted, total), patterns, total


def choose(texts: DataFrame, flow: dict, patterns: dict, seed: int = SEED) -> DataFrame:
    """(text_id, source, doc_id, n_uses, n_tokens) of the texts in the mix.

    The texts of a pattern lie on a line in seeded order, as long as their tokens. Every source in turn takes as long a
    stretch as the flow gives it, going round at the end; a text is used as often as the stretch covers its middle.
    """
    stretches, at = [], {}
    for (p, s), amount in sorted(flow.items()):
        start = at.get(p, 0)
        stretches.append((list(p), s, start, start + amount, patterns[p]))
        at[p] = start + amount
    spark = texts.sparkSession
    schema = T.StructType(
        [T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("source", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("length", T.LongType())]
    )
    table = F.broadcast(spark.createDataFrame(stretches, schema))  # one row per pattern and source, checked in plan()
    order = texts.withColumn("rank", F.xxhash64(F.lit(seed), "text_id"))
    n = order.count()
    buckets = max(1, -(-n // BUCKET_TEXTS))
    # running totals in two steps: of buckets by pattern, and of texts within a bucket
    order = order.withColumn("bucket", F.floor((F.shiftright("rank", 1).cast("double") / F.lit(2.0**63) + 0.5) * buckets).cast("long"))
    sums = order.groupBy("sources", "bucket").agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("sources").orderBy("bucket")) - F.col("s")).drop("s")
    w = Window.partitionBy("sources", "bucket").orderBy("rank", "text_id")
    placed = order.join(before, ["sources", "bucket"]).withColumn("middle", F.col("before") + F.sum("n_tokens").over(w) - F.col("n_tokens") / 2)
    used = placed.join(table, "sources").withColumn(
        "n_uses", (F.floor((F.col("b") - F.col("middle")) / F.col("length")) - F.floor((F.col("a") - F.col("middle")) / F.col("length"))).cast("long")
    )
    doc = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["doc_id"]
    return used.where("n_uses > 0").select("text_id", "source", doc.alias("doc_id"), "n_uses", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """The texts of the mix with how often each is used for which source. Empty tables give an empty mix."""
    wanted = targets_of(targets)
    texts = stage(distinct_texts(documents, sorted(wanted), path))
    flow, patterns, _ = plan(texts, wanted)
    return choose(texts, flow, patterns, seed)


def shares(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """Per source: target_share, quota_tokens, mix_tokens, its share of the mix as large as all documents (share_of_wanted)
    and of the mix as it came out (actual_share), n_uses, and whether its share is within reach."""
    wanted = targets_of(targets)
    texts = stage(distinct_texts(documents, sorted(wanted), path))
    flow, patterns, total = plan(texts, wanted)
    got: dict[str, int] = {}
    for (_, s), amount in flow.items():
        got[s] = got.get(s, 0) + amount
    rows = [(s, share, int(round(share * total)), got.get(s, 0)) for s, (share, _) in sorted(wanted.items())]
    spark = documents.sparkSession
    asked = spark.createDataFrame(rows, "source string, target_share double, quota_tokens long, planned_tokens long")
    taken = choose(texts, flow, patterns, seed).groupBy("source").agg(F.sum(F.col("n_uses") * F.col("n_tokens")).alias("mix_tokens"), F.sum("n_uses").alias("n_uses"))
    out = asked.join(taken, "source", "left")
    return out.select(
        "source",
        "target_share",
        "quota_tokens",
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        (F.coalesce("mix_tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("share_of_wanted"),
        (F.coalesce("mix_tokens", F.lit(0)) / F.lit(float(max(sum(got.values()), 1)))).alias("actual_share"),
        F.coalesce("n_uses", F.lit(0)).alias("n_uses"),
        (F.col("planned_tokens") >= F.col("quota_tokens")).alias("within_reach"),
    )
