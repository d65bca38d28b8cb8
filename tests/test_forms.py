"""Raw text forms: nesting, lengths and edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from pitengine.functions import forms as V

D = dt.date


def values(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("t"))).collect()]


def test_wikitext_at_any_depth(spark):
    assert values(spark, V.wikitext, "w " * 100_000 + "{{x}}") == [("w " * 100_000).strip()]
    deep = "x " + "{{a " * 40 + "b" + " }}" * 40 + " y"
    got = values(
        spark, V.wikitext, "[[File:a.jpg|thumb|A [[b|caption]] here]] left", deep, "'''Bold''' ''it'' [[Paris|the city]] [[Rome]]", "a<ref name=x/>b<ref>{{cite|http://q}}</ref>c<!-- no\n -->d",
        "== Head ==\nText [https://x.org label here] https://y.org end", "open {{never closed", "closed }} never opened", "", None, "a=b | c", "{{x|{{y}}}}[[a|{{z}}b]]", "[[Category talk]]",
    )
    assert got == ["left", "x y", "Bold it the city Rome", "a b c d", "Head Text label here end", "open never closed", "closed never opened", "", None, "a=b c", "b", "Category talk"]


def test_names_keep_their_length(spark):
    long = "the red " + "n" * 20_000
    assert values(spark, lambda c: V.without_prefix(c, ("small", "red")), long, "Red", "red red x", "other") == ["n" * 20_000, "red", "red x", "other"]


def test_prices_and_channels(spark):
    low_high = lambda c: F.array(*V.price_range(c))
    assert values(spark, low_high, "from $1,250.50 to 99.", "free", "5", None) == [[99.0, 1250.5], [None, None], [5.0, 5.0], [None, None]]
    urls = ("https://v.com/channel/UCabcdefghij?x=1", "https://v.com/@han.dle/", "https://v.com/user/some-one", "https://v.com/watch?v=1", "https://v.com/channel/UCshort", "https://v.com/@", None)
    assert values(spark, V.channel_id, *urls) == ["UCabcdefghij", "@han.dle", "some-one", None, None, None, None]


def test_dates_in_words(spark):
    single = lambda c: V.single_date(c, F.lit(1999))
    assert values(spark, single, "Oct. 26, 2013", "Oct 26", "Oct. 27, 2013 and Nov 1, 2013", "Oct. 27-28, 2013", "May 2 and May 3", "Feb 30, 2020", "no day", "Foo 12, 2020", None) == [D(2013, 10, 26), D(1999, 10, 26), None, None, None, None, None, None, None]
    phrase = lambda c: V.date_phrase(c, F.lit("2024-03-06").cast("date"))  # noqa: E731  a Wednesday
    assert values(spark, phrase, "March 9", "sept 3, 2025 at noon", "2024-05-01", "Wednesday", "Friday,", "marches 9", "soon", "Feb 29", "") == [D(2024, 3, 9), D(2025, 9, 3), D(2024, 5, 1), D(2024, 3, 13), D(2024, 3, 8), None, None, D(2024, 2, 29), None]


def test_dates_are_searched_once(spark):
    """No functions over the words of a text, which cut it once for each of them; the same days at the edges of words, years and spaces."""
    single = lambda c: V.single_date(c, F.lit(1999))
    phrase = lambda c: V.date_phrase(c, F.lit("2024-03-06").cast("date"))
    one = spark.createDataFrame([("May 2",)], "t string")
    for f in (single, phrase):
        assert "lambda" not in one.select(f(F.col("t")))._jdf.queryExecution().analyzed().toString()
    texts = ("May 2 2001 3", "x may\t02,  2001", "xmay 2", "May 2nd", "May 2 20011", "maybe 3", "May 2 1801", "may 2 may 3 2001", "May", "May 2001", "é may 2", "may 123", "20011 May 5", "Ma 2", "May 0", "May.2.2001")
    assert values(spark, single, *texts) == [D(2001, 5, 2), D(2001, 5, 2), None, None, D(1999, 5, 2), D(1999, 5, 3), D(1801, 5, 2), D(2001, 5, 3), None, None, D(1999, 5, 2), None, D(1999, 5, 5), None, None, D(2001, 5, 2)]
    texts = ("maybe 3", "on sept. 3, 2025", "may 2 june 3 2020", "2024-5-001", "2024-05-01\n", "202a-05-01", "monday,,", "mondays", " May 2, 2025 ,", "june 31", "février 3", None)
    assert values(spark, phrase, *texts) == [None, D(2025, 9, 3), D(2024, 5, 2), None, None, None, D(2024, 3, 11), None, D(2025, 5, 2), None, None, None]
