"""Normalisation of dates and instants written in many ways to UTC, with missing zones estimated from the data.

A clock reading without zone belongs to its source (a host). The zone of a source
is the candidate region whose offset history violates the fewest alignments. There
are two kinds: a zone-less reading next to the time its record was taken in, which
it precedes by less than half an hour; and one next to an instant, known with its
zone, of the same subject within a day, which it equals. The declared zone of a
source counts as a few alignments that hold in it alone, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.functions.instants import Stamp, stamps, to_utc
from filmloom.session import cut, stage

_STAMP = T.StructType(
    [
        T.StructField("local", T.TimestampNTZType()),
        T.StructField("precision", T.StringType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("zone", T.StringType()),
        T.StructField("numeric", T.BooleanType()),
    ]
)
DECLARED_COUNTS = 10
MAX_LAG_SECONDS = 1800
MOST_DECLARED = 10_000


@F.pandas_udf(T.ArrayType(_STAMP))
def read_stamps(values: pd.Series, orders: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"local": s.local, "precision": s.precision, "offset": s.offset, "zone": s.zone, "numeric": s.numeric} for s in stamps(v, o)]
            for v, o in zip(values, orders, strict=True)
        ]
    )


def parse(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """rows (rec_table, rec_key, source, subject, value) with `stamps`, in the date order declared for the source.

    `declared` (source, tz_name, date_order) is a small table that does not grow. Rows whose value is NULL or empty are
    dropped; repeated rows count once. Every row is read once: the result is a table in the shared folder.
    """
    rows = rows.select("rec_table", "rec_key", "source", "subject", "value").where("value IS NOT NULL AND value <> ''").distinct()
    order = declared.groupBy("source").agg(F.min("date_order").alias("date_order"))
    return stage(rows.join(order, "source", "left").withColumn("stamps", read_stamps("value", "date_order")))


def open_readings(parsed: DataFrame) -> DataFrame:
    """The zone-less clock readings of parsed rows: rec_table, rec_key, source, subject, local, coarse."""
    one = parsed.where(F.exists("stamps", lambda s: (s["zone"] == "local") & (s["precision"] != "day"))).select("rec_table", "rec_key", "source", "subject", F.explode("stamps").alias("s"))
    return one.where("s.zone = 'local' AND s.precision <> 'day'").select("rec_table", "rec_key", "source", "subject", F.col("s.local").alias("local"), (F.col("s.precision") == "minute").alias("coarse"))


def zone_violations(parsed: DataFrame, regions: list[str], ingested: DataFrame | None = None) -> DataFrame:
    """Per source and candidate region: n_aligned alignments and n_violations of the region's offset history.

    Every stamp of a value counts, not only its first. ingested: (rec_table, rec_key, at), when a record was taken in (UTC).
    """
    local = open_readings(parsed)
    known = parsed.where("subject IS NOT NULL AND subject <> ''").where(F.exists("stamps", lambda s: s["offset"].isNotNull() & (s["precision"] != "day"))).select("subject", F.explode("stamps").alias("s"))
    known = known.where("s.offset IS NOT NULL AND s.precision <> 'day'").select("subject", (F.col("s.local") - F.make_dt_interval(mins=F.col("s.offset"))).alias("utc")).distinct()
    # Both sides are distinct and cut to the day, so that a subject with very many rows does not multiply.
    near = local.where("subject IS NOT NULL AND subject <> ''").select("source", "subject", "local", "coarse").distinct()
    near = near.withColumn("day", F.explode(F.array(*[F.date_add(F.to_date("local"), k) for k in (-1, 0, 1)])))
    pairs = near.join(known.withColumn("day", F.to_date("utc")), ["subject", "day"]).select("source", "local", "utc", "coarse", F.lit(False).alias("lags")).distinct()
    if ingested is not None:
        taken = local.join(ingested, ["rec_table", "rec_key"]).where("abs(datediff(at, local)) <= 1")
        pairs = pairs.unionByName(taken.select("source", "local", F.col("at").alias("utc"), "coarse", F.lit(True).alias("lags")).distinct())

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zones = {name: ZoneInfo(name) for name in regions}
        for pdf in batches:
            out: dict = {}
            for source, local_, utc, coarse, lags in zip(pdf["source"], pdf["local"], pdf["utc"], pdf["coarse"], pdf["lags"], strict=True):
                distance = (local_ - utc).total_seconds()
                hits = []
                aware = utc.to_pydatetime().replace(tzinfo=ZoneInfo("UTC"))
                for name, z in zones.items():
                    off = (aware.astimezone(z).utcoffset() or timedelta(0)).total_seconds()
                    hits.append((name, 0 <= off - distance < MAX_LAG_SECONDS + 60 * coarse if lags else abs(distance - off) < (60 if coarse else 1)))
                if any(ok for _, ok in hits):  # else the two tell of different moments
                    for name, ok in hits:
                        n, bad = out.get((source, name), (0, 0))
                        out[source, name] = (n + 1, bad + (not ok))
            yield pd.DataFrame([(s, z, n, bad) for (s, z), (n, bad) in out.items()], columns=["source", "tz_name", "n_aligned", "n_violations"])

    counted = pairs.mapInPandas(test, "source string, tz_name string, n_aligned long, n_violations long")
    return counted.groupBy("source", "tz_name").agg(F.sum("n_aligned").alias("n_aligned"), F.sum("n_violations").alias("n_violations"))


def choose_zones(parsed: DataFrame, declared: DataFrame, ingested: DataFrame | None = None, weight: int = DECLARED_COUNTS, default_zone: str = "UTC") -> DataFrame:
    """(source, tz_name): the region of each source, one rule at every size.

    The declared zone (default_zone where none is) stands, unless another region violates less than half the share of the
    alignments it does, where the declared zone counts as `weight` alignments more that hold in it and in no other. A
    source with neither a declared zone nor a better one has no row. A declared table of more than MOST_DECLARED rows is
    an error.
    """
    rows = declared.limit(MOST_DECLARED + 1).collect()
    if len(rows) > MOST_DECLARED:
        raise ValueError(f"more than {MOST_DECLARED} declared zones: this is no table of sources")
    told = {r.source: r.tz_name for r in rows if r.source and r.tz_name}
    own = declared.sparkSession.createDataFrame(sorted(told.items()), "source string, told string")
    regions = sorted({*told.values(), default_zone})
    counts = zone_violations(parsed, regions, ingested).join(F.broadcast(own), "source", "left").withColumn("held", F.coalesce("told", F.lit(default_zone)))  # of checked size
    n = F.col("n_aligned") + weight
    sides = counts.groupBy("source").agg(
        F.max(F.when(F.col("tz_name") == F.col("held"), F.col("n_violations") / n)).alias("own"),
        F.min(F.when(F.col("tz_name") != F.col("held"), F.struct(((F.col("n_violations") + weight) / n).alias("share"), "tz_name"))).alias("other"),
    )
    better = sides.where(F.col("other.share") < 0.5 * F.col("own")).select("source", F.col("other.tz_name").alias("better"))
    return cut(own.join(better, "source", "full").select("source", F.coalesce("better", "told").alias("tz_name")))


def normalise(parsed: DataFrame, zones: DataFrame, default_zone: str | None = "UTC") -> DataFrame:
    """One row per stamp: rec_table, rec_key, source, value, pos, utc, precision, how, zone, is_ambiguous_order.

    `how`: day (a date has no zone), exact (offset written), zone (by region), gap and fold (by region, at a clock
    change: a time in a gap is moved on, a repeated one is its first occurrence), assumed (no zone known: default_zone).
    """
    schema = "rec_table string, rec_key string, source string, value string, pos int, utc timestamp_ntz, precision string, how string, zone string, is_ambiguous_order boolean"
    columns = [f.split()[0] for f in schema.split(", ")]
    told = parsed.where(F.size("stamps") > 0).join(zones, "source", "left")
    one = told.select("rec_table", "rec_key", "source", "value", "date_order", F.col("tz_name").alias("region"), F.posexplode("stamps").alias("p", "s")).select(
        "rec_table", "rec_key", "source", "value", (F.col("p") + 1).cast("int").alias("pos"), F.col("s.local").alias("local"), F.col("s.precision").alias("precision"), F.col("s.offset").alias("offset"), F.col("s.zone").alias("stated"),
        "region", (F.col("s.numeric") & F.col("date_order").isNull()).alias("is_ambiguous_order"),
    )
    sign = F.when(F.col("offset") < 0, "-").otherwise("+")
    shown = F.concat(F.lit("UTC"), sign, F.lpad(F.floor(F.abs("offset") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs("offset") % 60).cast("string"), 2, "0"))
    # dates and written offsets need no history of a region and stay in the JVM
    plain = one.where("precision = 'day' OR offset IS NOT NULL").select(
        "rec_table", "rec_key", "source", "value", "pos", F.when(F.col("precision") == "day", F.col("local")).otherwise(F.col("local") - F.make_dt_interval(mins=F.col("offset"))).alias("utc"), "precision",
        F.when(F.col("precision") == "day", "day").otherwise("exact").alias("how"), F.when(F.col("precision") != "day", shown).alias("zone"), "is_ambiguous_order",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                region = row.region if isinstance(row.region, str) else None
                utc, how = to_utc(Stamp(row.local.to_pydatetime(), row.precision, None, row.stated, False), region or default_zone)
                if row.stated == "local" and not region:
                    how = "assumed"
                out.append((row.rec_table, row.rec_key, row.source, row.value, row.pos, utc, row.precision, how, row.stated if row.stated != "local" else region, row.is_ambiguous_order))
            yield pd.DataFrame(out, columns=columns)

    return plain.unionByName(one.where("precision <> 'day' AND offset IS NULL").mapInPandas(run, schema))


def normal_form(utc, precision):
    """How a date or an instant of whole seconds is written in the normal form; NULL for other precisions."""
    text = utc.cast("string")  # of a timestamp without zone: the same in any session
    return F.when(precision == "day", F.substring(text, 1, 10)).when(precision == "second", F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))


def not_in_form(normalised: DataFrame) -> DataFrame:
    """(rec_table, rec_key) of values that state a full date or instant and are not what its normal form looks like."""
    form = normal_form(F.col("utc"), F.col("precision"))
    return normalised.where(F.col("value") != F.coalesce(form, F.lit(""))).select("rec_table", "rec_key").distinct()
