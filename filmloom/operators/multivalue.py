"""Splitting of fields that pack several values, by expectation-maximisation over segmentation lattices.

The model of a column is how often each value occurs in it. Strings without a
delimiter and quoted spans count as they stand; for the rest, all segmentations
at delimiters are weighed (E step: forward-backward, giving expected counts) and
counted again (M step), and at the end the most probable one is taken (Viterbi).
Values are as many as the data has, so the model is a table that is joined to
the candidate segments, never broadcast or collected. All work is on distinct
strings: a string that fills a third of the rows is one row here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmloom.functions import lattice
from filmloom.functions.bits import bit_field
from filmloom.session import cut

MOST_ITERATIONS = 30
TOLERANCE = 1e-3


@F.pandas_udf(T.LongType())
def _whole_key(texts: pd.Series) -> pd.Series:
    return texts.map(lattice.whole_key).astype("Int64")


@F.pandas_udf(T.StringType())
def _shape(values: pd.Series) -> pd.Series:
    return values.map(lattice.shape)


def field_elements(rows: DataFrame) -> DataFrame:
    """(rec_table, rec_key, field_name, elements ARRAY<STRING>) to one row per element with its position.

    NULL and blank elements are dropped; a repeated row of a key counts once.
    """
    return (
        rows.where("elements IS NOT NULL")
        .distinct()
        .select("rec_table", "rec_key", "field_name", F.posexplode("elements").alias("element_pos", "element"))
        .withColumn("element", F.regexp_replace("element", r"(?U)^\s+|\s+$", ""))
        .where("element IS NOT NULL AND element <> ''")
    )


# Everything that can part two values or quote one; strings without any of these are single values.
_MAY_SPLIT = r'[|;·•,/&\t\n\r+"“«]|(?i)\s(and|und|et|y)\s'

_MANY = rf"(?s)(?:(?:{_MAY_SPLIT}).+?){{{lattice.SHORT}}}"


def learn(elements: DataFrame, most_iterations: int = MOST_ITERATIONS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, float], dict[str, dict[str, float]], DataFrame]:
    """The model of every column: (counts table, totals, shape shares, candidate segments of ambiguous strings).

    Rounds end when no column's log-likelihood gains more than `tolerance` of itself.
    """
    strings = cut(elements.groupBy("field_name", "element").agg(F.count("*").cast("double").alias("w")))
    # runs of many pieces count where they are a whole string elsewhere: known by a bit field of fixed size
    wholes = bit_field(strings.where(F.col("element").rlike(_MANY)).select(_whole_key("element").alias("key")))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def candidates(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: lattice.candidates(t, wholes))

    segments = (
        strings.where(F.col("element").rlike(_MAY_SPLIT))
        .withColumn("candidates", candidates("element"))
        .select("field_name", "element", "w", F.size("candidates").alias("n"), F.explode("candidates").alias("value"))
    )
    segments = cut(segments)
    plain = strings.where(~F.col("element").rlike(_MAY_SPLIT)).select("field_name", F.col("element").alias("value"), "w")
    # a single candidate is no choice; a quoted span counts as it stands wherever it occurs
    sure = segments.where("n = 1").select("field_name", "value", "w")
    quoted = segments.where("n > 1").where(F.expr("contains(element, concat('\"', value, '\"'))")).select("field_name", "value", "w")
    seed = cut(plain.unionByName(sure).unionByName(quoted).groupBy("field_name", "value").agg(F.sum("w").alias("count")))
    shapes: dict[str, dict[str, float]] = {}
    # bounded by the few shapes of a column
    for r in seed.withColumn("shape", _shape("value")).groupBy("field_name", "shape").agg(F.sum("count").alias("c"), F.count_if(F.col("count") <= 1).alias("once")).collect():
        by = shapes.setdefault(r.field_name, {lattice.NEW: 0.0})
        by[r["shape"]] = r.c
        by[lattice.NEW] += r.once
    for by in shapes.values():
        once = by.pop(lattice.NEW)
        n = sum(by.values())
        by.update({s: c / n for s, c in by.items()})
        by |= {lattice.NEW: (once + 0.5) / (n + 1), lattice.RARE: 0.5 / (n + 1)}
    open_segments = segments.where("n > 1")
    fixed = plain.unionByName(sure).select("field_name", "value", F.col("w").alias("count"))
    model, before = seed, {}
    totals = _totals(model)
    for _ in range(most_iterations):
        found = with_counts(open_segments, model).mapInPandas(_e_step(totals, shapes), "field_name string, value string, count double")
        model = cut(fixed.unionByName(found).groupBy("field_name", "value").agg(F.sum("count").alias("count")))
        totals = _totals(model)
        likely = {r.field_name: r["count"] for r in model.where("value IS NULL").collect()}  # one row per column
        model = model.where("value IS NOT NULL")
        if all(f in before and v - before[f] <= tolerance * abs(v) for f, v in likely.items()):
            break
        before = likely
    return model, totals, shapes, segments


def _totals(model: DataFrame) -> dict[str, float]:
    return {r.field_name: r.t for r in model.where("value IS NOT NULL").groupBy("field_name").agg(F.sum("count").alias("t")).collect()}


def with_counts(segments: DataFrame, model: DataFrame) -> DataFrame:
    """One row per string with the counts of its candidates (as many as the string has, whatever the model's size)."""
    return (
        segments.join(model, ["field_name", "value"], "left")
        .groupBy("field_name", "element")
        .agg(F.first("w").alias("w"), F.collect_list(F.struct("value", F.coalesce("count", F.lit(0.0)).alias("count"))).alias("counts"))
    )


def _e_step(totals: dict, shapes: dict):
    """Expected counts of values; under the value NULL the log-likelihood of the column's strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict = {}
            for field, text, w, counts in zip(pdf["field_name"], pdf["element"], pdf["w"], pdf["counts"], strict=True):
                by = {c["value"]: c["count"] for c in counts}
                weights, likely = lattice.expected(text, by, totals.get(field, 1.0), shapes.get(field, {}))
                for value, e in [*weights.items(), (None, likely)]:
                    out[field, value] = out.get((field, value), 0.0) + w * e
            yield pd.DataFrame([(f, v, c) for (f, v), c in out.items()], columns=["field_name", "value", "count"])

    return run


def split(elements: DataFrame, most_iterations: int = MOST_ITERATIONS) -> DataFrame:
    """Elements with `values`, the list of values of each, in order. An element without delimiters is its own value.

    The model is joined to the candidates by value: one that is a candidate of very many strings is a hot key of their side
    only, which an adaptive join splits.
    """
    model, totals, shapes, segments = learn(elements, most_iterations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [
                lattice.viterbi(text, {c["value"]: c["count"] for c in counts}, totals.get(field, 1.0), shapes.get(field, {}))
                for field, text, counts in zip(pdf["field_name"], pdf["element"], pdf["counts"], strict=True)
            ]
            yield pd.DataFrame({"field_name": pdf["field_name"], "element": pdf["element"], "values": got})

    chosen = with_counts(segments, model).mapInPandas(run, "field_name string, element string, values array<string>")
    return elements.join(chosen, ["field_name", "element"], "left").withColumn("values", F.coalesce("values", F.array("element")))


def one_row_per_value(split_elements: DataFrame) -> DataFrame:
    """(rec_table, rec_key, field_name, value_pos, value, is_packed): positions 1, 2, ... over the whole field."""
    fields = split_elements.groupBy("rec_table", "rec_key", "field_name").agg(
        F.sort_array(F.collect_list(F.struct("element_pos", "values"))).alias("parts"),
        F.max(F.size("values") > 1).alias("is_packed"),
    )
    return fields.select(
        "rec_table", "rec_key", "field_name", "is_packed", F.posexplode(F.flatten("parts.values")).alias("p", "value")
    ).select("rec_table", "rec_key", "field_name", (F.col("p") + 1).cast("int").alias("value_pos"), "value", "is_packed")
