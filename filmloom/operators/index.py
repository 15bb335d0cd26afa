"""An inverted index in tables: weighted postings, document lengths, corpus statistics, and ranking on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.functions.text import search_tokens
from filmloom.session import stage

# The fields indexed with their weights, and the parameters of BM25.
FIELDS = {"title": 3.0, "description": 0.2, "synopsis": 2.0, "genres": 1.3, "director": 1.2, "cast": 1.5, "rating": 1.1}
K1, B = 1.5, 0.75
METHODS = ("standard", "probabilistic", "smooth", "max")


def documents_of(pages: DataFrame) -> DataFrame:
    """One document per file_path: of rows that differ the one with the higher scores; the id cascade's first step."""
    row = F.struct("tomatometer", "audience_score", *[c for c in pages.columns if c not in ("file_path", "tomatometer", "audience_score")])
    return pages.where("file_path IS NOT NULL").groupBy(F.col("file_path").alias("doc_id")).agg(F.max(row).alias("r")).select("doc_id", "r.*")


def tokens(documents: DataFrame, fields: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, field, term, n): how often a term occurs in a field of a document. NULL fields have no tokens."""
    fields = fields or FIELDS
    kinds = dict(documents.dtypes)
    present = [f for f in fields if f in kinds]
    text = lambda f: F.array_join(F.col(f"`{f}`"), " ") if kinds[f].startswith("array") else F.col(f"`{f}`").cast("string")
    per = F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("text")) for f in present])
    rows = documents.select("doc_id", F.explode(per).alias("x")).select("doc_id", "x.field", "x.text").where("text IS NOT NULL")
    out = rows.select("doc_id", "field", F.explode(search_tokens(F.col("text"))).alias("term"))
    return out.groupBy("doc_id", "field", "term").agg(F.count("*").alias("n"))


def build(documents: DataFrame, fields: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """postings (term, doc_id, wtf) and lengths (doc_id, dl).

    A field other than of weight 1 counts its weight once per term, however often the term occurs in it; the length
    counts every token. Documents without tokens have length 0.
    """
    fields = fields or FIELDS
    counted = stage(tokens(documents, fields))
    weight = F.create_map(*[x for f, w in fields.items() for x in (F.lit(f), F.lit(float(w)))])[F.col("field")]
    postings = counted.groupBy("term", "doc_id").agg(F.sum(F.when(weight == 1.0, F.col("n").cast("double")).otherwise(weight)).alias("wtf"))
    lengths = documents.select("doc_id").distinct().join(counted.groupBy("doc_id").agg(F.sum("n").alias("dl")), "doc_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
    return postings, lengths


def corpus(lengths: DataFrame) -> DataFrame:
    """One row: n documents and their mean length (of at least one token in all)."""
    return lengths.agg(F.count("*").alias("n"), (F.greatest(F.coalesce(F.sum("dl"), F.lit(0)), F.lit(1)) / F.count("*")).alias("avgdl"))


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def idf(method: str, n: Column, df: Column, max_df: Column) -> Column:
    """Inverse document frequency; 0 for a term without documents."""
    value = {
        "standard": F.log(n / df),
        "probabilistic": F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5))),
        "smooth": F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5)),
        "max": F.log(F.lit(1.0) + max_df / (df + 1.0)),
    }[method]
    return F.when(df > 0, value).otherwise(0.0)


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The tokens of a query with how often each occurs in it."""
    one = spark.createDataFrame([(query,)], "q string")
    return {r.term: r.times for r in one.select(F.explode(search_tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times")).collect()}


def _weighted(postings: DataFrame, lengths: DataFrame, terms: dict[str, int], needs_max: bool) -> DataFrame:
    """The postings of the terms with how often each is asked (times), its df, and the corpus' n, avgdl and max_df. The terms
    are literals of the filter, so that a saved index is read at their row groups only."""
    times = F.create_map(*[F.lit(x) for kv in sorted(terms.items()) for x in kv])[F.col("term")] if terms else F.lit(0)
    hits = postings.where(F.col("term").isin(sorted(terms))).withColumn("times", times)
    facts = corpus(lengths)
    most = frequencies(postings).agg(F.max("df").alias("max_df")) if needs_max else facts.select(F.lit(1).alias("max_df"))
    df = hits.groupBy("term").agg(F.count("*").alias("df")).join(facts).join(most)  # one row each
    return hits.join(F.broadcast(df), "term")  # as many rows as the query has terms


def _part(method: str, k1: float = K1, b: float = B) -> Column:
    """What a posting adds to its document's score. bm25 always goes by the probabilistic idf."""
    weight = idf("probabilistic" if method == "bm25" else method, F.col("n"), F.col("df"), F.col("max_df"))
    if method != "bm25":
        return F.col("wtf") * weight * F.col("times")
    length = F.greatest(F.lit(1), F.col("dl")) / F.col("avgdl")
    return weight * (F.col("wtf") * (k1 + 1.0)) / (F.col("wtf") + k1 * (1 - b + b * length)) * F.col("times")


def search(
    postings: DataFrame, lengths: DataFrame, query: str, method: str = "standard", bm25: bool = False, k: int | None = 10, only: DataFrame | None = None, k1: float = K1, b: float = B
) -> DataFrame:
    """(doc_id, score) of the best k documents, score to 6 digits; ties by doc_id. k=None returns all hits.

    `only` (doc_id) restricts the hits, not the statistics. A hit whose terms all have idf 0 is returned with score 0. A
    query without tokens has no hits.
    """
    scored = _weighted(postings, lengths, query_terms(postings.sparkSession, query), method == "max" and not bm25)
    if only is not None:
        scored = scored.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    if bm25:
        scored = scored.join(lengths.select("doc_id", "dl"), "doc_id")
    out = scored.groupBy("doc_id").agg(F.round(F.sum(_part("bm25" if bm25 else method, k1, b)), 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(k) if k else out


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (doc_id, score) with the columns of their documents, best first. A hit whose document is gone keeps its row."""
    return hits.join(documents, "doc_id", "left").orderBy(F.desc("score"), "doc_id")


def compare(postings: DataFrame, lengths: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(method, doc_id, score): the best k of every idf method and of BM25, in one pass over the postings of the query."""
    scored = _weighted(postings, lengths, query_terms(postings.sparkSession, query), True).join(lengths.select("doc_id", "dl"), "doc_id")
    names = ("bm25", *METHODS)
    totals = scored.groupBy("doc_id").agg(*[F.round(F.sum(_part(m)), 6).alias(m) for m in names])
    rows = totals.select("doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in names])).alias("x")).select("x.method", "doc_id", "x.score")
    w = Window.partitionBy("method").orderBy(F.desc("score"), "doc_id")  # cut to k in every task before the shuffle
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def analyse(postings: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, n, idf of each method) for terms, lower-cased and otherwise as they stand; df 0 where unknown."""
    asked = postings.sparkSession.createDataFrame([(t.lower(),) for t in terms], "term string").distinct()
    df = postings.join(F.broadcast(asked), "term").groupBy("term").agg(F.count("*").alias("df"))
    most = frequencies(postings).agg(F.max("df").alias("max_df"))
    rows = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).join(corpus(lengths)).join(most)
    return rows.select("term", "df", "n", *[F.round(idf(m, F.col("n"), F.col("df"), F.col("max_df")), 6).alias(f"idf_{m}") for m in METHODS])


def statistics(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: documents, tokens, distinct terms, mean length."""
    a = lengths.agg(F.count("*").alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"), F.round(F.greatest(F.coalesce(F.sum("dl"), F.lit(0)), F.lit(1)) / F.count("*"), 6).alias("avg_length"))
    return a.join(postings.agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings")))


def frequency_histogram(postings: DataFrame) -> DataFrame:
    return frequencies(postings).groupBy("df").agg(F.count("*").alias("n_terms"))


def top_terms(postings: DataFrame, k: int = 20) -> DataFrame:
    """(term, weight): terms by the sum of their weights (whole part), ties by term."""
    total = postings.groupBy("term").agg(F.floor(F.round(F.sum("wtf"), 6)).cast("long").alias("weight"))
    return total.orderBy(F.desc("weight"), "term").limit(k)


def upsert(postings: DataFrame, lengths: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after (re-)adding documents: the old rows of their ids go, the new ones come."""
    ids = documents.select("doc_id").distinct()
    new_postings, new_lengths = build(documents)
    return postings.join(ids, "doc_id", "left_anti").select(postings.columns).unionByName(new_postings), lengths.join(ids, "doc_id", "left_anti").unionByName(new_lengths)


def _generations(spark: SparkSession, path: str) -> list[int]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_DONE-*")
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    return sorted(int(f.getPath().getName().split("-")[1]) for f in found or [])


def save(postings: DataFrame, lengths: DataFrame, path: str, append: bool = False) -> int:
    """Write an index as a generation of its own and return its number.

    Postings are sorted by term, so that a lookup skips row groups. append adds a generation to those there are: its
    documents take the place of earlier ones of the same id, and nothing is rewritten. Without append earlier generations
    no longer count. A generation counts from when its marker is there; readers never see a part.
    """
    spark = postings.sparkSession
    there = _generations(spark, path)
    number = (there[-1] if there else 0) + 1
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings/generation={number}")  # of a write that broke off
    lengths.write.mode("overwrite").parquet(f"{path}/lengths/generation={number}")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.create(fs_path(f"{path}/_DONE-{number}"), True).close()
    if not append:
        for old in there:
            files.delete(fs_path(f"{path}/_DONE-{old}"), False)
    return number


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of a saved index: of each document its latest generation."""
    there = _generations(spark, path)
    if not there:
        raise ValueError(f"no index at {path}")
    read = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/generation={g}" for g in there])
    postings, lengths = read("postings"), read("lengths")
    if len(there) == 1:
        return postings.drop("generation"), lengths.drop("generation")
    newest = lengths.groupBy("doc_id").agg(F.max("generation").alias("generation"))
    current = lambda df: df.join(newest, ["doc_id", "generation"], "left_semi").drop("generation")
    return current(postings).select("term", "doc_id", "wtf"), current(lengths).select("doc_id", "dl")


def append(documents: DataFrame, path: str, fields: dict[str, float] | None = None) -> int:
    """Add documents to a saved index (or begin one); those of known ids are replaced. Returns the new generation."""
    return save(*build(documents, fields), path, append=True)
