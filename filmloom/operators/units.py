"""Conversion of amounts recorded in several units to one, with the unit chosen by the columns' identities.

Every value gives the readings its text allows (number x scale x currency); a number
below a thousand without a word of scale may be in single units, thousands or
millions. A reading of a value in the common unit is amount x scale x rate; the
identities that hold among the columns are on the log scale: each column has its
centre, and the two columns of a record keep a typical ratio (log box office - log
budget). Centres and spreads are medians over the records whose text leaves one
reading, so that no guess enters them. The combination of readings of a record
with the least sum of squared log residuals is chosen; where the second best
lies within a margin the solution is flagged as not unique.
"""

from __future__ import annotations

import math
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.functions.money import amount_readings
from filmloom.session import cut

READING = T.StructType(
    [
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("stated", T.BooleanType()),
    ]
)
MARGIN = 1.0
OPEN_SCALES = (1.0, 1e3, 1e6)
MOST_RATES = 1000


@F.pandas_udf(T.ArrayType(READING))
def readings(values: pd.Series) -> pd.Series:
    return values.map(lambda v: [x for r in amount_readings(v) for x in _fields(r)])


def _fields(r) -> list[dict]:
    return [{"low": r.low * k, "high": r.high * k, "scale": r.scale * k, "currency": r.currency, "stated": r.stated} for k in (OPEN_SCALES if r.scale_open and r.high > 0 else (1.0,))]


def _spread(col):
    """Centre and spread (median and scaled half of the middle half) of a column, as one struct."""
    q = F.percentile_approx(col, [0.25, 0.5, 0.75], 2000)
    return F.struct(q[1].alias("mid"), F.greatest((q[2] - q[0]) / F.lit(1.349), F.lit(0.05)).alias("dev"))


def convert(records: DataFrame, rates: DataFrame, key: str, fields: tuple[str, str], margin: float = MARGIN) -> DataFrame:
    """One row per (key, field) whose value states an amount: value_low and value_high in the common unit.

    Columns: key, field_name, raw, value_low, value_high, currency, scale, residual, n_readings, is_unique. Values
    without an amount (NULL, empty, "unknown") give no row; a currency without a rate gives a row with NULL amounts.
    Repeated rows of a key count once. `rates` is a small table (currency_code, usd_per_unit) that does not grow with
    the data: it goes into a map literal of at most one entry per currency; more than MOST_RATES rows are an error.
    """
    a, b = fields
    told = rates.select("currency_code", "usd_per_unit").where("usd_per_unit IS NOT NULL AND currency_code IS NOT NULL").limit(MOST_RATES + 1).collect()
    if len(told) > MOST_RATES:
        raise ValueError(f"more than {MOST_RATES} rates: this is no table of currencies")
    rate = {r.currency_code: float(r.usd_per_unit) for r in told}
    values = (
        records.select(F.col(f"`{key}`").alias("key"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
        .where("a IS NOT NULL OR b IS NOT NULL")
        .distinct()
    )
    read = cut(values.withColumn("ra", readings("a")).withColumn("rb", readings("b")))
    # Where the text leaves one reading each, the log amounts in the common unit are facts to learn the identities from.
    lookup = F.create_map(*[F.lit(x) for kv in rate.items() for x in kv]) if rate else F.expr("map('', 0D)")

    def log_usd(col: str):
        one = F.get(F.col(col), F.lit(0))
        worth = (one["low"] + one["high"]) / 2 * lookup[one["currency"]]
        return F.when((F.size(col) == 1) & (worth > 0), F.log10(worth))

    facts = read.select(log_usd("ra").alias("la"), log_usd("rb").alias("lb"))
    stats = facts.agg(_spread("la").alias("a"), _spread("lb").alias("b"), _spread(F.col("lb") - F.col("la")).alias("d")).collect()[0]
    mid = {k: (stats[k]["mid"], stats[k]["dev"] or 0.05) for k in "abd"}

    def best(pdf_iter):
        for pdf in pdf_iter:
            out = []
            for key_, va, vb, ra, rb in zip(pdf["key"], pdf["a"], pdf["b"], pdf["ra"], pdf["rb"], strict=True):
                ra, rb = list(ra) if ra is not None else [], list(rb) if rb is not None else []
                if not ra and not rb:
                    continue
                scored = []
                for x, y in product(ra or [None], rb or [None]):
                    lx, ly = _log(x, rate), _log(y, rate)
                    cost = _square(lx, mid["a"]) + _square(ly, mid["b"])
                    if lx is not None and ly is not None:
                        cost += _square(ly - lx, mid["d"])
                    scored.append((cost, x, y))
                order = sorted(range(len(scored)), key=lambda i: (scored[i][0], i))
                # the plainest reading stands unless another fits better by more than the margin
                win = order[0] if scored[0][0] - scored[order[0]][0] > margin else 0
                rest = [scored[i][0] for i in range(len(scored)) if i != win]
                unique = not rest or min(rest) - scored[win][0] > margin
                cost, x, y = scored[win]
                for name, raw, r, n in ((a, va, x, len(ra)), (b, vb, y, len(rb))):
                    if r is not None:
                        f = rate.get(r["currency"])
                        out.append((key_, name, raw, None if f is None else r["low"] * f, None if f is None else r["high"] * f, r["currency"], r["scale"], float(cost), n, bool(unique or n == 1)))
            yield pd.DataFrame(out, columns=["key", "field_name", "raw", "value_low", "value_high", "currency", "scale", "residual", "n_readings", "is_unique"])

    kind = records.schema[key].dataType.simpleString()
    return read.mapInPandas(
        best,
        f"key {kind}, field_name string, raw string, value_low double, value_high double, currency string, scale double, residual double, n_readings int, is_unique boolean",
    )


def _log(r, rate: dict) -> float | None:
    if r is None:
        return None
    f = rate.get(r["currency"])
    worth = (r["low"] + r["high"]) / 2 * f if f else 0
    return math.log10(worth) if worth > 0 else None


def _square(x: float | None, at: tuple) -> float:
    centre, dev = at
    return 0.0 if x is None or centre is None else ((x - centre) / dev) ** 2


def other_units(converted: DataFrame, unit: str = "USD") -> DataFrame:
    """Rows whose amount was stated in another currency than `unit` or in another scale than single units."""
    return converted.where((F.col("currency") != unit) | (F.col("scale") != 1.0))
