from palmleaf.operators import catalog, classify, dedup, graph, htmlpage, library, links, segment

STORY = "story_id long, url string, title string, status string, raw_sha256 string, series_title string, part_number int, words int, category string, category_source string, category_locked int, original_text string, formatted_text string, romanized_text string, updated_at string, added_at string"


def stories(spark, rows):
    base = dict(url=None, title="", status="verified", raw_sha256="", series_title="", part_number=None, words=0, category="", category_source="none", category_locked=0, original_text="", formatted_text="", romanized_text="", updated_at="", added_at="")
    names = [x.split()[0] for x in STORY.split(", ")]
    return spark.createDataFrame([tuple((base | {"url": f"https://a.example/{i}"} | r | {"story_id": i})[n] for n in names) for i, r in enumerate(rows, 1)], STORY)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_journal_fold(spark):
    j = spark.createDataFrame([(1, "a", ("failed", "x")), (2, "a", ("failed", None)), (3, "b", ("success", None)), (4, "c", None), (5, None, ("failed", "x")), (6, "d", ("odd", "y"))], "seq long, url string, state struct<status string, error string>")
    assert rows(links.fold_journal(j)) == [("a", "failed", "", 2), ("b", "scraped", "", 0), ("d", "pending", "y", 0)]
    snap = spark.createDataFrame([("a", "failed", "x")], "url string, status string, error string")
    assert rows(links.reconcile(snap, j, 1)) == [("a", "failed", "", 2), ("b", "scraped", "", 0), ("d", "pending", "y", 0)]
    assert links.fold_journal(j.limit(0)).collect() == []


def test_links(spark):
    log = spark.createDataFrame([(1, "https://a.example/x?utm_id=1"), (2, "https://A.example/x/"), (3, "https://a.example/y"), (4, None)], "link_id long, url string")
    assert sorted((r.link_id, r.n) for r in links.first_of_each(log).collect()) == [(1, 2), (3, 1)]


def test_duplicates(spark):
    st = stories(
        spark,
        [dict(raw_sha256="h"), dict(raw_sha256="h"), dict(title="My  Story"), dict(title="my story"), dict(series_title="S", part_number=1), dict(series_title="s", part_number=1), dict(series_title="S", part_number=2), dict(title="The moon and the river", words=500), dict(title="The moon and the rivers", words=505)],
    )
    assert rows(dedup.exact(st)) == [("h", 2, 1)]
    assert rows(dedup.by_title(st)) == [("part", "s#1", 2), ("title", "my story", 2)]
    assert rows(dedup.part_clashes(st)) == [("s", 1, 2)]
    assert [(r.a, r.b) for r in dedup.similar_titles(st).collect()] == [(8, 9)]
    many = stories(spark, [dict(title=f"the long title {chr(97 + i // 26)}{chr(97 + i % 26)}", words=10) for i in range(41)])
    assert rows(dedup.skipped_buckets(many)) == [(1, 41)] and dedup.similar_titles(many).count() == 0
    assert dedup.similar_titles(many, None).count() > 0


def test_similar_titles_in_large_buckets(spark, monkeypatch):
    """A bucket above the guard against brute force, in one block and in several."""
    titles = [f"the long title {chr(97 + i // 26)}{chr(97 + i % 26)}{'x' * (i % 5)}" for i in range(60)]
    st = stories(spark, [dict(title=t, words=10) for t in titles])
    want = [(r.a, r.b, r.ratio) for r in dedup.similar_titles(st, None).collect()]
    assert dedup.similar_titles(st).count() == 0 and len(want) > 100
    for block in (500, 7):
        monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
        assert sorted(tuple(r) for r in dedup.all_similar_titles(st).collect()) == sorted(want)


def test_series_and_catalog(spark):
    st = stories(spark, [dict(series_title="Moon", part_number=3, title="Moon 3", category="College"), dict(series_title="moon", part_number=1, title="Moon 1", category="College"), dict(title="One", category="Work", added_at="2024-01-01T00:00:00Z")])
    assert rows(catalog.series_list(st)) == [("moon", 2, 3, "2")]
    got = rows(catalog.catalog(st).select("title", "category", "added_at", "n_parts"))
    assert got == [("One", "Work", 1704067200, 1), ("moon", "College", 0, 2)]
    assert rows(catalog.totals(catalog.catalog(st))) == [(2, 3)]
    assert [r.path for r in catalog.paths(st).orderBy("story_id").collect()][1:] == ["College/moon/Part 001.html", "Work/One.html"]
    a = catalog.fingerprints(catalog.catalog(st))
    b = catalog.fingerprints(catalog.catalog(st.where("story_id <> 1")))
    assert [r.change for r in catalog.diff(a, b).collect()] == ["updated"]
    assert catalog.diff(a, a).collect() == []


def test_integrity(spark):
    st = spark.createDataFrame([(1, "verified", "r", "f", "", ""), (2, "pending", "", "g", "", "")], "story_id long, status string, raw_file string, formatted_file string, romanized_file string, organized_file string")
    files = spark.createDataFrame([("raw", "r"), ("formatted", "g"), ("formatted", "h")], "stage string, name string")
    assert rows(catalog.missing_files(st, files)) == [("missing_formatted_file", "f", 1)]
    assert rows(catalog.orphan_files(st, files)) == [("orphan_formatted_file", "h")]


def test_classification(spark):
    st = stories(spark, [dict(title="A ghost", original_text="work"), dict(title="x", original_text="the office"), dict(title="ghostly"), dict(title="Ghost 2", series_title="S", part_number=2), dict(title="No 1", series_title="s", part_number=1)])
    cats = ["Ghost", "Work"]
    found = classify.classified(st, cats, {"Work": ["office"]})
    assert rows(found) == [(1, "Ghost", "title"), (2, "Work", "content"), (3, "Uncategorized", "none"), (4, "Ghost", "title"), (5, "Uncategorized", "none")]
    assert rows(classify.consensus(st, found, cats))[3:] == [(4, "Ghost", "title"), (5, "Ghost", "title")]
    assert rows(classify.affected(st, st.where("story_id = 5"))) == [(4,), (5,)]
    assert classify.clean_aliases(["Work = office, work", "Odd = x"], cats) == {"Work": ["office"]}


def paragraphs(spark, text, **kw):
    row = segment.formatted(stories(spark, [dict(original_text=text)]), **kw).first()
    return (row.formatted.split("\n\n") if row.formatted else []), row


def test_segmentation(spark):
    got, row = paragraphs(spark, "Mother: come in. Ravi: at 11:30 then. Note: x http://a.example")
    assert got == ["Mother: come in.", "Ravi: at 11:30 then. Note: x http://a.example"] and (row.breaks, row.turns, row.unsplit, row.quality_pass) == (1, 2, 0, 1)
    got, row = paragraphs(spark, "He looked up. Brother: where? Sister: here. Mother: no. Teacher: wait.")
    assert len(got) == 5 and row.breaks == 4
    assert paragraphs(spark, "V: a. N: b. P: c. V: d. K: e.")[1].breaks == 4
    assert paragraphs(spark, "Ravi:hello there. Anil:- yes.")[0] == ["Ravi:hello there.", "Anil:- yes."]
    assert paragraphs(spark, "We saw Elder brother: he ran. Police officer: stop.")[0][-1].startswith(("officer:", "Police officer:"))
    assert paragraphs(spark, "then xyz: one and xyz: two but abc: three")[0] == ["then", "xyz: one and", "xyz: two but abc: three"]
    assert paragraphs(spark, "రాము: రా. సీత: సరే.")[1].breaks == 1
    long = " ".join(["word"] * 700)
    parts, row = paragraphs(spark, long, limit=500)
    assert len(parts) > 5 and max(map(len, parts)) <= 600 and " ".join(parts) == long
    told = " ".join(f"Sentence {i} is as long as this one is, and it ends here." for i in range(40))
    parts, row = paragraphs(spark, told)
    assert " ".join(parts) == told and all(p.count("ends here.") <= 4 for p in parts) and row.longest < 900
    st = stories(spark, [dict(original_text="Mother: a. Ravi: b.\nx &amp; y"), dict(original_text=""), dict(original_text=None)])
    done = segment.formatted(st)
    assert rows(segment.faithful(st, done)) == [(1, 1), (2, 1)]
    joined = spark.createDataFrame([(1, "Ravi: a. Mother: b."), (2, "x" * 2000), (3, None)], "story_id long, formatted string")
    out = {r.story_id: r for r in segment.block_quality(joined).collect()}
    assert (out[1].unsplit, out[1].quality_pass, out[1].review_reason) == (1, 0, "1 dialogue turn(s) are still joined inside paragraphs")
    assert (out[2].longest, out[2].quality_pass, out[2].review_reason) == (2000, 0, "Longest paragraph is 2000 characters") and out[3].paragraphs in (0, -1, None)


def test_pages(spark):
    html = "<html><head><title>T &amp; t</title><script>x</script></head><body><nav>menu</nav><article><h1>T & t</h1><p>one <b>two<br>three</p><blockquote>q</blockquote><a href='/n?x=1'>go</a></article></body></html>"
    df = spark.createDataFrame([(1, "https://a.example/p", html), (2, None, ""), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in htmlpage.parsed(df).collect()}
    assert [(b.kind, b.text) for b in got[1].blocks] == [("paragraph", "one two"), ("paragraph", "three"), ("quote", "q"), ("paragraph", "go")]
    assert got[1].title == "T & t" and [tuple(x) for x in got[1].links] == [("https://a.example/n?x=1", "go")]
    assert got[2].blocks == [] and 3 not in got
    assert rows(htmlpage.page_titles(df))[0] == (1, "T &amp; t")


def test_search(spark):
    st = stories(spark, [dict(title="The village", original_text="by night-train"), dict(title="x", original_text="Mountains of café")])
    idx = library.postings(st)
    hit = lambda q: [r[0] for r in library.matches(idx, q).collect()]
    assert hit("village") == [1] and hit("night-train") == [1] and hit("mount") == [2] and hit("vill x") == [] and hit("...") == [] and hit("") == []


def test_crawl(spark):
    e = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c")], "src string, dst string")
    s = spark.createDataFrame([("r", 0)], "url string, depth int")
    assert rows(graph.crawl(e, s, 2)) == [("a", 1), ("b", 2), ("r", 0)]
    assert graph.crawl(e, s.limit(0), 2).count() == 0


def test_crawl_replay(spark):
    j = spark.createDataFrame([(1, "v", "old", ["x"]), (2, "start", None, ["r"]), (3, "v", "r", ["a", "b"]), (4, "v", "a", None), (5, "done", None, None)], "seq long, t string, url string, links array<string>")
    assert rows(graph.replayed(j)) == [("a", "visited"), ("b", "queued"), ("r", "visited")]


def test_schema_and_settings(spark):
    from pyspark.sql import functions as F

    from palmleaf.functions import settings
    from palmleaf.operators import schema

    old = spark.createDataFrame([(1, "u", None, "x")], "story_id long, url string, telugu string, extra string")
    one = schema.conformed(old, schema.STORIES)
    assert one.schema.names == schema.STORIES.names and one.first().telugu == 0 and one.first().part_number is None and one.first().title == ""
    assert schema.merged(old, one, schema=schema.STORIES).distinct().count() == 1
    df = spark.createDataFrame([("7",), ("x",), ("900",), (None,)], "v string")
    assert [r[0] for r in df.select(settings.clamp(F.col("v"), "auto_batch")).collect()] == [7, 20, 200, 20]
    assert settings.site_profiles("# c\nA.example = 3\nb.example=-1\nc.example=x\nd.example=99") == {"a.example": 3.0, "b.example": 0.0, "d.example": 60.0}
    t = spark.createDataFrame([("Café — The  Story!",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(settings.slug(F.col("t"))).collect()] == ["cafe-the-story", "", None]
