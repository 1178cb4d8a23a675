from pyspark.sql import functions as F

from palmleaf.functions import text, titles, translit, urls


def col(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_library_key(spark):
    a, b, c, d, e, f, g = col(
        spark,
        [
            "https://example.com/story?id=123&utm_source=x",
            "https://example.com/story?id=123",
            "https://example.com/story/",
            "https://example.com/",
            "https://Example.COM/story",
            "https://a.example/story?b=2&a=1",
            None,
        ],
        urls.library_key,
    )
    assert a == b and c == "https://example.com/story" and d == "https://example.com/" and e == "https://example.com/story"
    assert f == "https://a.example/story?a=1&b=2" and g is None
    assert col(spark, [a, c, d, f], urls.library_key) == [a, c, d, f]  # once is enough


def test_crawl_key(spark):
    assert col(spark, ["HTTPS://A.example/b/../c/", "http://a.example:80/x//y", "ftp://a/b", "https://a.example"], urls.crawl_key) == ["https://a.example/c/", "http://a.example/x/y", None, "https://a.example/"]


def test_url_parts(spark):
    assert col(spark, ["https://u:p@Host.Example:8443/a", "http://[::1]:80/x", "nonsense", None], urls.host) == ["host.example", "::1", "", None]
    assert col(spark, ["https://a.example/x/my-first_story/", "https://a.example"], urls.title_from) == ["my first story", "https://a.example"]
    assert col(spark, ["https://a.example/x.PDF", "https://a.example/x.%70df", "https://a.example/x.html"], urls.is_page) == [False, False, True]
    inside = lambda c: urls.in_scope(c, "https://a.example/root")
    assert col(spark, ["https://a.example/root", "https://a.example/root/x", "https://a.example/rootless", "https://b.example/root/x"], inside) == [True, True, False, False]


def test_series(spark):
    got = col(spark, ["My Story Part 1", "My Story - Pt. 12", "My Story (Part 3)", "My Story 1", "My Story - 2", "My Story Chapter 3", "My Story Episode 4", "My Story 2026", "", None, "Part 0"], titles.series)
    assert [(r.base, r.part) for r in got] == [
        ("My Story", 1), ("My Story", 12), ("My Story", 3), ("My Story", 1), ("My Story", 2), ("My Story Chapter 3", None), ("My Story Episode 4", None),
        ("My Story 2026", None), ("Untitled Story", None), ("Untitled Story", None), ("Part 0", None),
    ]


def test_error_class(spark):
    assert col(spark, ["HTTP 404 Not Found", "timed out 404", "ETIMEDOUT", "etimedout", "HTTP 503", "odd", "", None], titles.error_class) == ["permanent", "permanent", "transient", "unknown", "transient", "unknown", "unknown", "unknown"]


def test_component(spark):
    assert col(spark, ["a/b: c?", "con", " .x. ", "", None], lambda c: titles.component(c, "none")) == ["a b c", "_con", "x", "none", "none"]


def test_text(spark):
    assert col(spark, ["a &amp;amp; b  c", None, ""], text.normal_text) == ["a & b c", None, ""]
    assert col(spark, ["a b\n c", "", None], text.word_count) == [3, 0, 0]
    assert col(spark, ["2024-01-01T00:00:10Z", "2024-01-01 00:00:10", "2024-01-01T05:30:10+05:30", "bad", "", None], text.epoch) == [1704067210] * 3 + [0] * 3
    assert col(spark, ["<a href='x'>&\"", None], text.escape_html) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", None]


def test_transliteration():
    cases = {"నా": "naa", "రోజు": "roju", "ఒక": "oka", "తెలుగు": "telugu", "ఈ": "ee", "నేను": "nenu", "పేరు": "peru"}
    assert {k: translit.letters(k) for k in cases} == cases
    assert translit.word("బస్సులో", {"బస్సు": "bus"}) == "buslo" and translit.word("బస్సు", {"బస్సు": "-"}) == translit.letters("బస్సు")
    assert translit.markup("<b title='నా'>నా</b>", {}) == "<b title='నా'>naa</b>"
    assert translit.text("నా x", {}, both=True) == "నా (naa) x"


def test_phonetic(spark):
    from palmleaf.functions import phonetic, translit

    sounds = lambda f, ws: [r[0] for r in spark.createDataFrame([(w,) for w in ws], "w string").select(f(F.col("w"))).collect()]
    assert sounds(phonetic.english_sound, ["phone", "bus", "station", "School", None]) == ["fon", "bas", "stesh@n", "skul", None]
    assert sounds(phonetic.telugu_sound, ["skool", "phon"]) == ["skul", "fon"]
    assert sounds(lambda c: phonetic.outline(phonetic.english_sound(c)), ["station", "match"]) == ["stSn", "mC"]
    assert phonetic.distance("fon", "fon") == 0 and phonetic.distance("fan", "fon") == 0.35 and phonetic.distance("fin", "kin") == 1 and abs(phonetic.distance("fon", "fn") - 0.8) < 1e-9
    words = translit.transliterated(spark.createDataFrame([("ఫోన్", 1), ("స్కూల్", 2), ("కథన్", 1), (None, 1)], "word string, n long").where("word is not null"))
    english = spark.createDataFrame([("phone", 5), ("Phone", 9), ("fun", 1), ("school", 2), (None, 3)], "english string, rank long")
    found = phonetic.guesses(words, english)
    assert {r.word: r.guess for r in found.collect()} == {"ఫోన్": "phone", "స్కూల్": "school"}
    corpus = spark.createDataFrame([("ఫోన్", "phone"), ("స్కూల్", "skull"), ("కథన్", translit.word("కథన్", {}))], "word string, latin string")
    assert sorted(r.word for r in phonetic.gated(corpus, words, found).collect()) == ["కథన్", "ఫోన్"]
    assert phonetic.guesses(words.limit(0), english).collect() == []
