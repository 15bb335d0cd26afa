"""Compaction, units, timestamps and packed fields: methods, edge cases, round trips."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filmloom.functions import bits, instants, lattice, money
from filmloom.operators import compaction, multivalue, timestamps, units


@pytest.mark.parametrize(
    ("given_", "want"),
    [("data/a//b.html ", "data/a/b.html"), (".\\data\\a\\b.html", "data/a/b.html"), ("file:///srv/x/data/a/../a/./b.html", "data/a/b.html"), ("/srv/data/a/b", "data/a/b"), ("", None), (None, None), ("  ", None), ("x/y", "x/y"), ("../data/a", "data/a")],
)
def test_paths(spark, given_, want):
    rows = spark.createDataFrame([(given_,)], "p string")
    assert rows.select(compaction.canonical_path(F.col("p")).alias("x")).collect()[0].x == want


@given(st.lists(st.integers(0, 130), max_size=200))
@settings(max_examples=60, deadline=None)
def test_packing_bounds(sizes):
    sizes = sorted(sizes, reverse=True)
    bins: dict[int, list[int]] = {}
    for b, s in zip(compaction.pack_even(sizes, 100), sizes, strict=True):
        bins.setdefault(b, []).append(s)
    assert sum(map(len, bins.values())) == len(sizes)
    assert all(sum(v) <= 100 or len([x for x in v if x]) == 1 for v in bins.values())


STORED = "file_path string, n_bytes bigint, modified_at timestamp_ntz, checksum string, bin_id string"


def test_compaction(spark, tmp_path):
    t = datetime(2024, 1, 1)
    files = [(f"data/{'hot' if i % 3 else 'cold'}/f{i}.html", 100 + i, t, f"c{i}", "x") for i in range(60)]
    stored = spark.createDataFrame([*files, ("data//hot/f1.html", 101, t, "c1", "x"), (None, 1, t, "c", "x"), ("data/hot/none", None, t, "z", "x")], STORED)
    urls = spark.createDataFrame([(f[0],) for f in files] + [("",), (None,)], "file_path string")
    manifest = compaction.freeze_manifest(stored, urls)
    assert manifest.count() == 61 and manifest.where("named").count() == 60
    plan = compaction.plan_bins(manifest, target_bytes=1000, shard_files=25)
    sums = plan.groupBy("bin_id").agg(F.sum("n_bytes").alias("s"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 61 and all((r.s or 0) <= 1000 for r in sums) and len(sums) <= 12
    assert {r.store_dir for r in compaction.small_file_dirs(plan, min_files=30).collect()} == {"data/hot"}
    records = spark.createDataFrame([(f[0], f"t{i}", "clash", i) for i, f in enumerate(files)] * 2 + [(files[0][0], None, None, 0)], "file_path string, title string, bin_id string, __path int")
    report = compaction.rewrite(plan, records, str(tmp_path / "out")).collect()
    assert sum(r.n_records for r in report) == 60 and sum(r.n_missing for r in report) == 1 and all(r.verified for r in report)
    out = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("snapshot")]
    assert len(out) == 1 and [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_COMMITTED")]
    back = spark.read.parquet(str(out[0]))
    assert back.count() == 60 and back.select("file_path").distinct().count() == 60
    assert len([p for p in out[0].rglob("*.parquet")]) == len(report)  # one file a bin
    assert {r.file_path: r.file_checksum for r in back.collect()} == {f[0]: f[3] for f in files}
    with pytest.raises(ValueError, match="without a record"):
        compaction.rewrite(plan, records, str(tmp_path / "strict"), allow_missing=False)
    assert not [p for p in (tmp_path / "strict").iterdir() if p.name.startswith("snapshot")]
    # without packing (a bin for each file) nothing is consolidated and no directory is listed
    alone = plan.withColumn("bin_files", F.lit(1))
    assert compaction.small_file_dirs(alone, min_files=30).count() == 0
    empty = compaction.plan_bins(compaction.freeze_manifest(stored.limit(0), urls))
    assert empty.count() == 0 and compaction.small_file_dirs(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "low", "high", "currency", "scale"),
    [("C$5 to C$8 million", 5e6, 8e6, "CAD", 1e6), ("half a million pounds", 5e5, 5e5, "GBP", 1e6), ("US$24.74e6", 24.74e6, 24.74e6, "USD", 1e6), ("1億円", 1e8, 1e8, "JPY", 1e8), ("Rs. 1205.0 x 10^6", 1.205e9, 1.205e9, "INR", 1e6),
     ("83.8×10⁶ USD", 83.8e6, 83.8e6, "USD", 1e6), ("$60 304 000", 60304000, 60304000, "USD", 1), ("$3,6 Mio.", 3.6e6, 3.6e6, "USD", 1e6), ("kr 31.2 mil.", 31.2e6, 31.2e6, "SEK", 1e6), ("592000", 592000, 592000, "USD", 1),
     ("[[Film budgeting|US $12,8 Mio.]]", 12.8e6, 12.8e6, "USD", 1e6), ("₹18–21 crore", 18e7, 21e7, "INR", 1e7), ("USD 290711000<!-- 2 billion -->", 290711000, 290711000, "USD", 1), ("nine million zloty", 9e6, 9e6, "PLN", 1e6)],
)
def test_amounts(text, low, high, currency, scale):
    r = money.amount_readings(text)[0]
    assert (r.low, r.high, r.currency, r.scale) == (pytest.approx(low), pytest.approx(high), currency, scale)


@pytest.mark.parametrize(
    ("text", "low", "high", "currency", "scale"),
    [("5億9000万円", 5.9e8, 5.9e8, "JPY", 1e8), ("3億10000万円", 4e8, 4e8, "JPY", 1e8), ("1억 5000만 원", 1.5e8, 1.5e8, "KRW", 1e8), ("5億2千5百万円", 5.25e8, 5.25e8, "JPY", 1e8), ("3億-5億9000万円", 3e8, 5.9e8, "JPY", 1e8),
     ("1 crore 50 lakh rupees", 1.5e7, 1.5e7, "INR", 1e7), ("$2 billion 300 million", 2.3e9, 2.3e9, "USD", 1e9), ("2 crore and 50 lakh rupees", 2.5e7, 2.5e7, "INR", 1e7), ("between 2 crore and 50 lakh rupees", 5e6, 2e7, "INR", 1e7),
     ("$5 million 3 million", 5e6, 5e6, "USD", 1e6), ("US$4 million (5億9000万円)", 4e6, 4e6, "USD", 1e6)],
)
def test_amounts_in_scale_groups(text, low, high, currency, scale):
    """Adjacent groups of falling scale are one number; its currency stands behind the last."""
    r = money.amount_readings(text)
    assert len(r) == 1 and (r[0].low, r[0].high, r[0].currency, r[0].scale) == (pytest.approx(low), pytest.approx(high), currency, scale)


@pytest.mark.parametrize("text", [None, "", "unknown", "see notes", "N/A", "<ref>5 million</ref>", "x" * 100_000])
def test_no_amount(text):
    assert money.amount_readings(text) == []


@pytest.mark.parametrize(
    ("text", "currency"),
    [("NZ$5,000", "NZD"), ("HK$ 3,000", "HKD"), ("DKK 5,000", "DKK"), ("NOK 10,000", "NOK"), ("CN¥500,000", "CNY"), ("5,000 rubles", "RUB"), ("XQ$5,000", "XQ$"), ("12,000 RMB", "CNY"), ("3 million kroner", "kroner"), ("5,000 Hong Kong dollars", "HKD"), ("TOP 5,000", "TOP"), ("approx $5,000", "USD"), ("US$5,000", "USD"), ("20 million Norwegian kroner", "NOK")],
)
def test_currencies_beyond_the_rate_table(text, currency):
    """A currency that is not in the rate table is named, or kept as it is written; it is never taken for US dollars."""
    assert {r.currency for r in money.amount_readings(text)} == {currency}


def test_open_scale_is_decided_by_the_identities(spark):
    """"$85" is 85 million where budgets are of that size; with no other column to go by (no facts) it stays 85."""
    rows = [(str(i), f"US$ {40 + i % 70} million", f"US$ {120 + 3 * (i % 70)} million") for i in range(80)] + [("open", "$85", "$260 million"), ("small", "$60,000", "$90 million"), ("none", "NZ$ 5,000", None)]
    rates = spark.createDataFrame([("USD", 1.0)], "currency_code string, usd_per_unit double")
    w = spark.createDataFrame(rows, "id string, a string, b string")
    got = {(r.key, r.field_name): r for r in units.convert(w, rates, "id", ("a", "b")).collect()}
    assert (got["open", "a"].value_low, got["open", "a"].scale) == (85e6, 1e6) and got["small", "a"].value_low == 60000 and got["none", "a"].value_low is None
    assert ("open", "a") in {(r.key, r.field_name) for r in units.other_units(units.convert(w, rates, "id", ("a", "b"))).collect()}
    alone = units.convert(w.where("id = 'open'").select("id", "a", F.lit(None).cast("string").alias("b")), rates, "id", ("a", "b")).collect()
    assert [(r.value_low, r.is_unique) for r in alone] == [(85.0, False)]
    with pytest.raises(ValueError):
        units.convert(w, spark.range(1001).selectExpr("cast(id as string) AS currency_code", "1D AS usd_per_unit"), "id", ("a", "b"))


def test_units_by_residual(spark):
    """A number that its text leaves open is read as the other column makes likely; a lone one is flagged."""
    rows = [(str(i), f"US$ {1 + i % 7}.5 million", f"US$ {3 + 3 * (i % 7)}.5 million") for i in range(60)] + [("open", "$1,234 million", "$3.1 million"), ("sek", "kr 5", None), ("none", None, None), ("sek", "kr 5", None)]
    w = spark.createDataFrame(rows, "id string, a string, b string").withColumn("key", F.lit("clash"))
    rates = spark.createDataFrame([("USD", 1.0), ("SEK", 0.1), (None, 2.0)], "currency_code string, usd_per_unit double")
    got = {(r.key, r.field_name): r for r in units.convert(w, rates, "id", ("a", "b")).collect()}
    assert got["open", "a"].value_low == pytest.approx(1.234e6) and got["open", "a"].n_readings == 2
    assert got["sek", "a"].value_low == pytest.approx(5e5) and got["sek", "a"].scale == 1e6 and ("none", "a") not in got
    assert {(r.key, r.field_name) for r in units.other_units(units.convert(w, rates, "id", ("a", "b"))).collect()} >= {("sek", "a"), ("open", "a")}
    assert units.convert(w.limit(0), rates.limit(0), "id", ("a", "b")).count() == 0


@pytest.mark.parametrize(
    ("text", "local", "precision", "offset"),
    [("26 November 2018 (premiere), 23 February 2019 (general)", datetime(2018, 11, 26), "day", None), ("{{Film date|1994|6|5}}", datetime(1994, 6, 5), "day", None), ("2009-11-01 01:36:00 EDT", datetime(2009, 11, 1, 1, 36), "second", -240),
     ("1557214800000", datetime(2019, 5, 7, 7, 40), "millisecond", 0), ("Fri, 28 Jun 2019 14:51:11 -0400", datetime(2019, 6, 28, 14, 51, 11), "second", -240), ("11. Januar 2017", datetime(2017, 1, 11), "day", None), ("20240923", datetime(2024, 9, 23), "day", None),
     ("1958-02-09T01:59:24.000125Z", datetime(1958, 2, 9, 1, 59, 24, 125), "microsecond", 0), ("Jun 15, 1974 2:48 AM local time", datetime(1974, 6, 15, 2, 48), "minute", None), ("5 de mayo de 2011", datetime(2011, 5, 5), "day", None), ("* [[1159115996.0]]", datetime(2006, 9, 24, 16, 39, 56), "second", 0)],
)
def test_stamps(text, local, precision, offset):
    s = instants.stamps(text)[0]
    assert (s.local, s.precision, s.offset) == (local, precision, offset)


@pytest.mark.parametrize("text", [None, "", "1994", "January 1963", "Q3 2019", "Summer 2023", "TBA", "{{Film date|1956}}", "31 February 2001", "2001-13-45", "1989-03", "z" * 50_000])
def test_no_stamp(text):
    assert instants.stamps(text) == []


def test_order_gap_and_fold():
    assert instants.stamps("04-05-1971", "mdy")[0].local.month == 4 and instants.stamps("04-05-1971", "dmy")[0].local.month == 5 and instants.stamps("04-24-1971", "dmy")[0].local.month == 4
    gap = instants.to_utc(instants.stamps("2013-03-10 02:24:00")[0], "America/New_York")
    fold = instants.to_utc(instants.stamps("2017-11-05 01:20:00")[0], "America/New_York")
    assert gap == (datetime(2013, 3, 10, 7, 24), "gap") and fold == (datetime(2017, 11, 5, 5, 20), "fold")


def test_zone_estimate(spark):
    """A source whose declared zone is violated by nearly all alignments gets the one that fits; few alignments change nothing."""
    rows, declared = [], spark.createDataFrame([("h", "Europe/Paris", "dmy"), ("k", "America/New_York", "mdy")], "source string, tz_name string, date_order string")
    for i in range(40):
        day = f"2001-{1 + i % 12:02d}-{1 + i % 28:02d}"
        ny = instants.to_utc(instants.stamps(f"{day} 09:00:00")[0], "America/New_York")[0]
        rows += [("rt", f"a{i}", "h", f"s{i}", f"{day} 09:00:00"), ("rt", f"b{i}", "k", f"s{i}", ny.strftime("%Y-%m-%dT%H:%M:%SZ"))]
    rows += [("rt", "n", "h", None, None), ("rt", "e", "h", "s", ""), ("rt", "u", "unknown", "s", "2001-01-01 10:00")]
    parsed = timestamps.parse(spark.createDataFrame([(*r, "x") for r in rows], "rec_table string, rec_key string, source string, subject string, value string, stamps string"), declared)
    zones = timestamps.choose_zones(parsed, declared)
    assert zone_of(zones)["h"] == "America/New_York" and zone_of(timestamps.choose_zones(parsed, declared, weight=1000))["h"] == "Europe/Paris"
    got = timestamps.normalise(parsed, zones)
    assert {r.how for r in got.where("rec_key = 'u'").collect()} == {"assumed"}
    assert {r.rec_key for r in timestamps.not_in_form(got).collect()} == {f"a{i}" for i in range(40)} | {"u"}
    assert timestamps.normalise(timestamps.parse(parsed.limit(0), declared), zones.limit(0)).count() == 0
    assert zone_of(timestamps.choose_zones(timestamps.parse(parsed.limit(0), declared), declared)) == {"h": "Europe/Paris", "k": "America/New_York"}
    with pytest.raises(ValueError):
        timestamps.choose_zones(parsed, spark.range(10_001).selectExpr("cast(id as string) AS source", "'UTC' AS tz_name", "'dmy' AS date_order"))


def zone_of(zones) -> dict:
    return {r.source: r.tz_name for r in zones.collect()}


def test_zone_estimate_from_ingestion(spark):
    """A source whose declared zone puts its readings after the time they were taken in gets the region that does not; the
    instants follow. Without the alignments they stay an hour off."""
    declared = spark.createDataFrame([("h", "Europe/London", "dmy"), ("k", "Europe/Paris", "dmy"), ("z", "Europe/Paris", "dmy")], "source string, tz_name string, date_order string")
    rows, at = [], []
    for i in range(60):
        local = datetime(2001, 1 + i % 12, 1 + i % 28, 9, i % 60)
        for source in ("h", "k"):  # both in truth Paris: read, and taken in five minutes later
            utc, _ = instants.to_utc(instants.stamps(f"{local:%Y-%m-%d %H:%M:%S}")[0], "Europe/Paris")
            rows.append(("rt", f"{source}{i}", source, None, f"{local:%Y-%m-%d %H:%M:%S}"))
            at.append(("rt", f"{source}{i}", utc + timedelta(minutes=5)))
        rows.append(("rt", f"z{i}", "z", None, f"{local:%Y-%m-%d %H:%M:%S}"))  # taken in years later: tells nothing
        at.append(("rt", f"z{i}", datetime(2020, 1, 1)))
    parsed = timestamps.parse(spark.createDataFrame(rows, "rec_table string, rec_key string, source string, subject string, value string"), declared)
    ingested = spark.createDataFrame(at, "rec_table string, rec_key string, at timestamp_ntz")
    zones = timestamps.choose_zones(parsed, declared, ingested)
    assert zone_of(zones) == {"h": "Europe/Paris", "k": "Europe/Paris", "z": "Europe/Paris"} and zone_of(timestamps.choose_zones(parsed, declared))["h"] == "Europe/London"
    utc = lambda zones: {r.rec_key: r.utc for r in timestamps.normalise(parsed, zones).collect()}
    with_it, without = utc(zones), utc(timestamps.choose_zones(parsed, declared))
    assert all(with_it[f"h{i}"] == with_it[f"k{i}"] != without[f"h{i}"] for i in range(60))


def test_one_zone_rule_at_every_size(spark):
    """Alignments of which half are chance change nothing, at a hundred as at ten thousand."""
    declared = spark.createDataFrame([("h", "Europe/Paris", "dmy"), ("k", "America/New_York", "mdy")], "source string, tz_name string, date_order string")
    for n in (100, 10_000):
        counts = [("h", "Europe/Paris", n, n * 55 // 100), ("h", "America/New_York", n, n * 45 // 100), ("h", "UTC", n, n)]
        original = timestamps.zone_violations
        timestamps.zone_violations = lambda *a, c=counts: spark.createDataFrame(c, "source string, tz_name string, n_aligned long, n_violations long")
        try:
            assert zone_of(timestamps.choose_zones(None, declared))["h"] == "Europe/Paris"
        finally:
            timestamps.zone_violations = original


@pytest.mark.parametrize(("value", "listed"), [("2001-02-03", False), ("2001-02-03T04:05:06Z", False), ("2001-02-03T04:05:06+00:00", True), ("2001-02-03T04:05Z", True), (" 2001-02-03", True), ("2001-02-03; 2001-02-04", True), ("2001-02-03T04:05:06.000Z", True), ("1994", False)])
def test_normal_form(spark, value, listed):
    declared = spark.createDataFrame([("h", "Europe/Paris", "dmy")], "source string, tz_name string, date_order string")
    parsed = timestamps.parse(spark.createDataFrame([("rt", "a", "h", None, value)], "rec_table string, rec_key string, source string, subject string, value string"), declared)
    assert (timestamps.not_in_form(timestamps.normalise(parsed, declared.select("source", "tz_name"))).count() == 1) == listed


def test_zone_estimate_from_all_stamps(spark):
    """The clock times of a value count wherever they stand in it."""
    rows, declared = [], spark.createDataFrame([("h", "Europe/Paris", "dmy"), ("k", "America/New_York", "mdy")], "source string, tz_name string, date_order string")
    for i in range(30):
        day = f"2001-{1 + i % 12:02d}-{1 + i % 28:02d}"
        ny = instants.to_utc(instants.stamps(f"{day} 09:00:00")[0], "America/New_York")[0]
        rows += [("rt", f"a{i}", "h", f"s{i}", f"{day}; {day} 09:00:00"), ("rt", f"b{i}", "k", f"s{i}", f"{day}; {ny:%Y-%m-%dT%H:%M:%SZ}")]
    parsed = timestamps.parse(spark.createDataFrame(rows, "rec_table string, rec_key string, source string, subject string, value string"), declared)
    assert zone_of(timestamps.choose_zones(parsed, declared))["h"] == "America/New_York"


def test_lattice_pieces():
    assert lattice.pieces('"A, B"; C & D')[0] == ("A, B", "C", "D")
    assert lattice.pieces("")[0] == () and lattice.pieces(" , ;")[0] == () and lattice.pieces('Ann "Bo, Z" Cy')[0] == ('Ann "Bo, Z" Cy',)


def test_value_of_many_pieces_stays_whole():
    """A value with four or more delimiters inside is kept, alone and beside another, where the counts say so."""
    value = "Bonaire, Saba, Statia, Aruba, Sint Eustatius and Curacao"
    counts, shapes = {value: 50.0, "France": 50.0}, {lattice.shape(value): 0.5, lattice.shape("France"): 0.5, lattice.NEW: 0.01, lattice.RARE: 1e-4}
    assert value in lattice.candidates(value) and lattice.whole_key("a, b") is None and lattice.viterbi(value, counts, 100.0, shapes) == [value]
    assert lattice.viterbi(f"{value}; France", counts, 100.0, shapes) == [value, "France"]


def test_packed_fields(spark):
    rng = random.Random(5)
    base = ["France", "Spain", "India", "Trinidad and Tobago", "Korea, Republic of"]
    rows = [("t", str(i), "c", [rng.choice(base)]) for i in range(150)]
    rows += [("t", "x1", "c", ["Spain, France and India"]), ("t", "x2", "c", ["Trinidad and Tobago | Spain"]), ("t", "x3", "c", ['"Korea, Republic of"/France', "India"]), ("t", "x4", "c", ["Korea, Republic of"]), ("t", "x5", "c", None), ("t", "x6", "c", ["", None])]
    rows += [("t", "x7", "c", ["France; " * 400])] + rows[-3:-2]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec_table string, rec_key string, field_name string, elements array<string>, element int")
    got: dict = {}
    for r in multivalue.one_row_per_value(multivalue.split(multivalue.field_elements(df.drop("element")))).collect():
        got.setdefault(r.rec_key, {})[r.value_pos] = (r.value, r.is_packed)
    assert [got["x1"][k][0] for k in (1, 2, 3)] == ["Spain", "France", "India"] and got["x1"][1][1]
    assert [got["x2"][k][0] for k in (1, 2)] == ["Trinidad and Tobago", "Spain"]
    assert [got["x3"][k][0] for k in (1, 2, 3)] == ["Korea, Republic of", "France", "India"]
    assert len(got["x4"]) == 1 and not got["x4"][1][1] and "x5" not in got and "x6" not in got and len(got["x7"]) == 400
    assert multivalue.one_row_per_value(multivalue.split(multivalue.field_elements(df.drop("element").limit(0)))).count() == 0


def test_rounds_end_when_the_likelihood_does(spark, monkeypatch):
    """The number of rounds follows the data, and every round makes the column likelier."""
    rng = random.Random(3)
    base = ["Ann Lee", "Bo Cho", "Cy Dun and Sons", "Eve Fox"]
    rows = [("t", str(i), "c", [rng.choice(base)]) for i in range(60)] + [("t", f"x{i}", "c", [", ".join(rng.sample(base, 2))]) for i in range(40)]
    rounds: list = []
    original = multivalue._e_step
    monkeypatch.setattr(multivalue, "_e_step", lambda *a: rounds.append(1) or original(*a))
    elements = multivalue.field_elements(spark.createDataFrame(rows, "rec_table string, rec_key string, field_name string, elements array<string>"))
    multivalue.learn(elements)
    assert 2 <= len(rounds) < multivalue.MOST_ITERATIONS
    counts, shapes = {"Ann Lee": 30.0, "Bo Cho": 30.0}, {lattice.shape("Ann Lee"): 1.0, lattice.NEW: 0.01, lattice.RARE: 1e-4}
    weights, likely = lattice.expected("Ann Lee, Bo Cho", counts, 60.0, shapes)
    assert likely < 0 and weights["Ann Lee"] == pytest.approx(weights["Bo Cho"]) and sum(weights.values()) == pytest.approx(2, abs=0.01)


def test_long_candidates_are_the_whole_strings_of_the_column(spark):
    """Of the runs of many pieces exactly those that are a whole string elsewhere are candidates (and a few by chance)."""
    rng = random.Random(1)
    names = [f"{a}{b}" for a in "KLMNP" for b in ("aro", "ibe", "odu", "ent")]
    wholes = [", ".join(rng.sample(names, rng.randrange(5, 8))) for _ in range(30)]
    texts = [f"{rng.choice(names)}; {w}; {rng.choice(names)}" for w in wholes] + [f'"{wholes[0]}"; {wholes[1]}']
    field = bits.bit_field(spark.createDataFrame([(lattice.whole_key(w),) for w in [*wholes, "Karo, Libe"]], "key long"))
    for t, w in zip(texts, wholes, strict=False):
        long = {c for c in lattice.candidates(t, field) if len(lattice.pieces(c)[0]) > lattice.SHORT}
        assert long >= {w, lattice.segment(t, 0, len(lattice.pieces(t)[0]))} and len(long) <= 3
    assert wholes[1] in lattice.candidates(texts[-1], field)
    assert len(lattice.candidates("; ".join(["France"] * 5000), field)) <= 10  # linear in the pieces, not square
