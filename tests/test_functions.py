"""Expressions on text, URLs, pages and wiki markup against hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from filmloom.functions import html, text, url, wikitext
from filmloom.sources import wiki_dump


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.x for r in spark.createDataFrame(rows, "i int, s string").select("i", f(F.col("s")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    given = ["The Matrix", "Amélie (2001 film)", "Fast & Furious", "Rocky II", "Rocky II Returns", "A.I.", "The", "Москва", None, ""]
    assert column(spark, given, text.normalize_title) == ["matrix", "amelie", "fast and furious", "rocky ii", "rocky 2 returns", "i", "the", "", "", ""]


def test_years(spark):
    assert column(spark, ["Jun 5, 1998", "1899", "2001-2003", "x19991", "", None], text.year_from_text) == [1998, None, 2001, None, None, None]


def test_urls(spark):
    given = ["http://WWW.Example.com/A/", "https://example.com", "http://e.com/fr/825?page=2&ref=x", "https://e.com/en/25#top", "https://e.com/a?href=1", None]
    want = ["https://example.com/A", "https://example.com/", "https://e.com/fr/825?page=2", "https://e.com/en/25", "https://e.com/a", None]
    assert column(spark, given, url.normalize) == want
    assert column(spark, want, url.normalize) == want  # idempotent


def test_links(spark):
    page = """<a href="x.html">1</a><a HREF='/m/a/?utm_source=q'>2</a><i data-href="../b">3</i><i data-url="//h.org/c">4</i><a href="#t"></a><a href="z.PDF"></a><a href="z.pdf"></a>"""
    got = column(spark, [page, "", None], lambda c: url.links(c, F.lit("http://e.com/d/e/f")))
    assert got == [["https://e.com/d/e/x.html", "https://e.com/m/a", "https://e.com/d/b", "https://h.org/c", "https://e.com/d/e/z.PDF"], [], None]


def test_durations_ratings_entities(spark):
    assert column(spark, ["PT2H16M", "PT45M", "PT", "x", None], lambda c: text.hours_minutes(text.iso_minutes(c))) == ["2h 16m", "45m", "0m", "", ""]
    assert column(spark, ["pg13", "TV14", "XYZ", None], text.normalize_rating) == ["PG-13", "TV-14", "", ""]
    assert column(spark, ["A&nbsp;&amp;  B", "&amp;quot;x", None], text.clean_entities) == ["A & B", '"x', ""]


def test_scores(spark):
    rows = spark.createDataFrame([(None, "87"), ("150", "42%"), ("9.5/10", None), ("n/a", None)], "a string, b string")
    assert [r.x for r in rows.select(text.bounded_score(F.col("a"), F.col("b")).alias("x")).collect()] == [87, 42, 9, None]


def test_tokens(spark):
    got = column(spark, ["The PG-13 Spider-Man", "Up in TV-MA", "Café on R", "ﬁne Łódź", None], text.search_tokens)
    assert got == [["pg13", "spider-man"], ["tvma"], ["cafe", "r"], ["fine", "łodz"], []]


PAGE = """<link rel="canonical" href="https://h/m/up"><meta name="description" content="Balloons &amp; a dog">
<script id="media-scorecard-json" type="x">{"criticsScore":{"score":"98"},"audienceScore":{"score":"90"},"description":"A  house flies."}</script>
<script type="application/ld+json">{"@type":"Movie","name":"Up","genre":["Adventure","Adventure"],"duration":"PT1H36M",
"contentRating":"PG","dateCreated":"2009-05-29","director":[{"name":"P. D."}],"actor":[{"name":"E. A."},{"name":"E. A."}]}</script>"""


def test_page(spark):
    pages = spark.createDataFrame([("a.html", PAGE), ("b.html", ""), ("c.html", None), ("site_tv_d.html", "<html"), ("e.html", '<script id="media-hero-json" x>{bad')], "file_path string, html string")
    got = {r.file_path: r for r in html.extract_pages(pages, "site").collect()}
    up = got["a.html"]
    assert (up.page_type, up.title, up.tomatometer, up.audience_score, up.genres, up.runtime, up.rating, up.release_date, up.rt_year) == ("movie", "Up", 98, 90, ["Adventure"], "1h 36m", "PG", "2009-05-29", 2009)
    assert (up.director, up.cast, up.synopsis, up.description) == ("P. D.", ["E. A."], "A house flies.", "Balloons &amp; a dog")
    assert got["b.html"].page_type == got["c.html"].page_type == "unknown" and got["b.html"].tomatometer is None
    assert got["site_tv_d.html"].page_type == "tv" and got["site_tv_d.html"].tomatometer == 0
    assert len(got) == 5


@pytest.mark.parametrize(("name", "canonical", "want"), [("site_m_up.html", "", "movie"), ("site_series_x.html", "", "tv"), ("x.html", "https://h/celebrity/y", "celebrity"), ("x.html", "https://h/critics/y", "critic"), ("x.html", "", "unknown")])
def test_page_type(spark, name, canonical, want):
    page = f'<link rel="canonical" href="{canonical}">' if canonical else ""
    rows = spark.createDataFrame([(name, page)], "n string, h string")
    assert rows.select(html.page_type(F.col("n"), F.col("h"), F.lit(None).cast("variant"), "site").alias("t")).collect()[0].t == want


BOX = """{{Infobox film
| director = [[Ann B|Ann Bee]]
| starring = {{Plainlist|
* X One
* Y Two
}}
| budget =
| released = {{Film date|1999|3|31}}
| runtime = 136 minutes
| country = Freedonia
| language = English
}}"""


def test_infobox():
    film = wikitext.film_of("intro " + BOX + " rest 2005")
    assert film["director"] == ["Ann Bee"] and film["starring"] == ["X One", "Y Two"] and film["language"] == ["English"]
    assert (film["released"], film["year"], film["runtime_minutes"], film["budget"]) == ("1999", 1999, 136, None)
    assert wikitext.film_of("{{Infobox film | director = A") is None and wikitext.film_of("") is None and wikitext.film_of(None) is None


def test_dump(spark, tmp_path):
    page = "<page><title>{t}</title><id>{i}</id><revision><text xml:space='preserve'>{x}</text></revision></page>\n"
    xml = "<mediawiki>\n" + page.format(t="Alpha (1999 film)", i=1, x=BOX) + page.format(t="The Alfa", i=2, x="#REDIRECT [[Alpha (1999 film)]]") + page.format(t="Mission: Beta", i=3, x=BOX) + page.format(t="User:x", i=4, x=BOX) + "</mediawiki>"
    (tmp_path / "d.xml").write_text(xml)
    pages = wiki_dump.read_pages(spark, str(tmp_path / "d.xml"))
    assert pages.count() == 4
    films = wiki_dump.film_records(pages)
    assert sorted(r.wiki_title for r in films.collect()) == ["Alpha (1999 film)", "Mission: Beta"]  # a colon alone is no namespace
    assert [r.wiki_title for r in wiki_dump.film_records(pages, drop_all_colons=True).collect()] == ["Alpha (1999 film)"]
    both = wiki_dump.with_aliases(films, wiki_dump.redirect_records(pages))
    assert sorted((r.wiki_page_id, r.wiki_title_norm) for r in both.collect()) == [("1", "alfa"), ("1", "alpha"), ("3", "mission beta")]
