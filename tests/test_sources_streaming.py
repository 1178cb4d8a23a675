import gzip
import json

import pytest

from palmleaf.operators import links
from palmleaf.sources import readers
from palmleaf.streaming import journal


def test_readers(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"main_site": "m", "sublinks": [{"link": "https://a.example/1", "title": "one"}, {"url": "https://a.example/2", "name": ""}, {"link": "mailto:x"}]}, {"sublinks": [{"link": "http://b.example"}]}]))
    assert [(r.source, r.url, r.title) for r in readers.link_file(spark, str(tmp_path / "l.json")).orderBy("pos").collect()] == [("m", "https://a.example/1", "one"), ("m", "https://a.example/2", "https://a.example/2"), ("Source 2", "http://b.example", "http://b.example")]
    (tmp_path / "s.txt").write_text("# c\nhttps://a.example\n\nhttps://a.example\nhttps://b.example\n")
    assert [r.url for r in readers.site_list(spark, str(tmp_path / "s.txt")).orderBy("pos").collect()] == ["https://a.example", "https://b.example"]
    (tmp_path / "u.jsonl").write_text('https://a.example/x\n{"href": "https://a.example/y", "title": "t"}\nbad\n')
    assert sorted((r.url, r.title) for r in readers.url_lines(spark, str(tmp_path / "u.jsonl")).collect()) == [("https://a.example/x", None), ("https://a.example/y", "t")]
    (tmp_path / "m.json").write_text("broken")
    (tmp_path / "m.bak").write_text(json.dumps({"version": 1, "pages": {"u": {"status": "success", "words": 3}}}))
    assert [(r.url, r.status, r.words) for r in readers.manifest(spark, str(tmp_path / "m.json"), str(tmp_path / "m.bak")).collect()] == [("u", "success", 3)]
    (tmp_path / "j.log").write_text('{"url": "u", "state": {"status": "failed", "error": "e"}}\n{"url": "v"\n')
    assert [(r.url, r.state.status) for r in readers.journal(spark, str(tmp_path / "j.log")).collect()] == [("u", "failed")]
    (tmp_path / "x.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc> https://a.example/?a=1&amp;b=2 </loc></url></urlset>"))
    assert [tuple(r) for r in readers.sitemap(spark, str(tmp_path / "x.xml.gz")).collect()] == [("urlset", "https://a.example/?a=1&b=2")]
    (tmp_path / "w.tsv").write_text("# c\na\tx\nb = y\na  z\n", encoding="utf-8")
    assert sorted(tuple(r) for r in readers.lexicon(spark, str(tmp_path / "w.tsv")).collect()) == [("a", "z"), ("b", "y")]


def test_files(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([["https://a.example/1"], [[{"href": "https://a.example/2", "name": "two"}]], {"url": "https://a.example/1"}, 5, None]))
    assert sorted((r.url, r.title) for r in readers.url_file(spark, str(tmp_path / "n.json")).collect()) == [("https://a.example/1", None), ("https://a.example/2", "two")]
    assert [r.files for r in readers.folder_sizes(spark, str(tmp_path)).collect()] == [1]


def test_tail(spark, tmp_path):
    from palmleaf.streaming.tail import JournalTail

    spark.dataSource.register(JournalTail)
    f = tmp_path / "j.log"
    line = lambda u, s: json.dumps({"url": u, "state": {"status": s}}) + "\n"
    out = []

    def run():
        q = spark.readStream.format("journal_tail").option("path", str(f)).load().writeStream.foreachBatch(lambda b, _: out.extend(r.url for r in b.orderBy("seq").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()

    f.write_text(line("a", "failed") + "broken\n" + '{"url": "half"')
    run()
    assert out == ["a"]


def test_tail_offsets(tmp_path):
    from palmleaf.streaming import tail

    f = tmp_path / "j.log"
    f.write_bytes(b'{"url": "a", "state": {"status": "x"}}\nbad\n{"url": "b"')
    r = tail._Reader(str(f))
    end = r.latestOffset()
    assert [x[1] for x in tail.records(str(f), 0, end["at"])] == ["a"] and end["at"] == f.read_bytes().rfind(b"\n") + 1
    with f.open("ab") as g:
        g.write(b', "state": {"status": "y"}}\n')
    more = r.latestOffset()
    assert [x[1] for x in tail.records(str(f), end["at"], more["at"])] == ["b"]
    f.write_bytes(b'{"url": "c", "state": {}}\n')
    cut = r.latestOffset()
    assert [(p.start, p.end) for p in r.partitions(more, cut)] == [(0, cut["at"])]
    f.write_bytes(b'{"url": "d", "state": {}}\n' * 5)  # cut and grown beyond the known offset
    regrown = r.latestOffset()
    spans = r.partitions(cut, regrown)
    assert [(p.start, p.end) for p in spans] == [(0, regrown["at"])] and regrown["generation"] > cut["generation"] > more["generation"]
    old, new = [list(r.read(p)) for p in (r.partitions(more, cut)[0], spans[0])]
    assert len(new) == 5 and min(x[0] for x in new) > max(x[0] for x in old)
    again = tail._Reader(str(f)).latestOffset()  # a restart goes on where the file was left
    assert r.partitions(regrown, again) == [] and r.latestOffset() == regrown


def test_journal_order_over_files(spark, tmp_path):
    line = lambda u, s: json.dumps({"url": u, "state": {"status": s}}) + "\n"
    (tmp_path / "1.log").write_text(line("u", "failed") * 3 + line("v", "failed"))
    (tmp_path / "2.log").write_text(line("u", "success") + line("w", "failed") * 40)
    got = {r.url: r.status for r in links.fold_journal(readers.journal(spark, str(tmp_path))).collect()}
    assert got == {"u": "scraped", "v": "failed", "w": "failed"}


def test_unreadable_version_fails(spark, tmp_path):
    from palmleaf.streaming import versions

    target = str(tmp_path / "t")
    rows = spark.createDataFrame([("u", 1), ("v", 2)], "url string, n int")
    change = lambda old, new: new if old is None else old.join(new.select("url"), "url", "left_anti").unionByName(new)
    assert versions.current(spark, target) is None
    versions.merge(rows, target, 0, "url", change)
    versions.merge(spark.createDataFrame([("u", 5)], "url string, n int"), target, 1, "url", change)
    versions.merge(spark.createDataFrame([("u", 5)], "url string, n int"), target, 1, "url", change)
    assert sorted(map(tuple, versions.current(spark, target).collect())) == [("u", 5), ("v", 2)]
    for f in (tmp_path / "t").rglob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        versions.merge(spark.createDataFrame([("u", 6)], "url string, n int"), target, 2, "url", change)
    assert not (tmp_path / "t" / "v=2" / "_SUCCESS").exists()


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/fetch_journal.parquet"
    batch = spark.read.parquet(d)
    src = tmp_path / "in"
    batch.where("seq % 2 = 0").coalesce(1).write.mode("append").parquet(str(src))
    batch.where("seq % 2 = 1").coalesce(1).write.mode("append").parquet(str(src))
    got = journal.run_once(journal.folded(journal.stream(spark, str(src), per_trigger=1)), str(tmp_path / "cp"), "states")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, links.fold_journal(batch).collect()))
    q = journal.upsert_into(journal.folded(journal.stream(spark, str(src), per_trigger=1)), str(tmp_path / "t"), str(tmp_path / "cp2"))
    q.awaitTermination()
    from palmleaf.streaming import versions

    assert sorted(map(tuple, versions.current(spark, str(tmp_path / "t")).select(*got.columns).collect())) == sorted(map(tuple, got.collect()))


def test_index_stream(spark, tmp_path):
    from palmleaf.operators import library
    from palmleaf.streaming import index, versions

    schema = "story_id long, title string, url string, original_text string, romanized_text string, updated_at string, deleted boolean"
    src = tmp_path / "in"
    spark.createDataFrame([(1, "moon", "u", "", "", "1", False), (2, "sun", "u", "", "", "1", False)], schema).coalesce(1).write.mode("append").parquet(str(src))
    run = lambda: index.index_into(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(1, "star", "u", "", "", "2", False), (2, "sun", "u", "", "", "2", True)], schema).coalesce(1).write.mode("append").parquet(str(src))
    run()
    last = versions.current(spark, str(tmp_path / "t"))
    hit = lambda q: [r[0] for r in library.matches(last, q).collect()]
    assert hit("moon") == [] and hit("star") == [1] and hit("sun") == []
