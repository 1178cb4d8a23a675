import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palmleaf.llm import boilerplate, language, leaks, lines, linklog, neardup, packing, quality, residue
from palmleaf.llm import queries as Q
from palmleaf.llm.words import WordHasher, words
from palmleaf.session import table

DIR = "/root/testdata/sf0.001"


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_words():
    assert words("Don't stop, O'NEIL! తెలుగు-2") == ["dont", "stop", "oneil", "తెలుగు2"]
    assert words(None) == words("") == words("--- !!") == []
    assert words("a_b c\x1cd") == ["ab", "c", "d"]


# --- 5 --------------------------------------------------------------------------------------------------


def test_link_log(spark):
    urls = [
        (1, "https://A.example:443/x//?b=2&a=1&utm_id=7#f"), (2, " https://a.example/x?a=1&b=%32\n"), (3, "http://a.example:443/x?a=1&b=2"), (4, "https://a.example/X?a=1&b=2"),
        (5, "https://a.example/?q="), (6, "https://a.example?q="), (7, "https://a.example?&UTM_ID=1&q=&"), (8, "https://a.example"), (9, None), (10, "  "), (11, "https://a.example/x?a=1&b=2&b=2"),
        (12, "https://a.example/a%20b?c=d+e"), (13, "https://a.example/a b?c=d%20e"), (14, "https://a.example/%zz"), (15, "https://a.example/%zz"), (16, "https://www.a.example"), (17, "https://a.example/?p"), (18, "https://a.example/?p="),
    ]
    df = spark.createDataFrame([(i, u, "k") for i, u in urls], "link_id long, url string, n string")
    assert got(linklog.copies(df, ["utm_id"])) == [(1, 2), (5, 6), (5, 7), (12, 13), (14, 15), (17, 18)]
    assert got(linklog.pages(df, ["utm_id"]).select("first_id", "n"))[:2] == [(1, 2), (3, 1)]
    assert linklog.copies(df.limit(0), []).collect() == []


def test_link_log_hot_url(spark, monkeypatch):
    monkeypatch.setattr(linklog, "HOT_SHARE", 0.1)
    df = spark.createDataFrame([(i, "https://a.example/hot" if i % 3 == 0 else f"https://a.example/{i // 2}") for i in range(60)], "link_id long, url string")
    want = {}
    for i, u in df.collect():
        want.setdefault(u, []).append(i)
    assert got(linklog.copies(df, [])) == sorted((min(v), x) for v in want.values() for x in v if x != min(v))


# --- 6 --------------------------------------------------------------------------------------------------


def test_repeated_lines(spark):
    rows = [(i, f"u{i % 6}", "h", f"First line {i} of a story.\n\n  Share this, with friends! {i}\n--\nAll rights are reserved\nshort") for i in range(8)]
    rows += [(100 + i, "u0", "other", "All rights are reserved") for i in range(9)] + [(200, None, "h", "All rights are reserved"), (201, "u9", None, "All rights are reserved"), (202, "u9", "h", None), (203, "u9", "h", "")]
    df = spark.createDataFrame(rows, "story_id long, url string, source_host string, original_text string")
    want = sorted((i, n) for i in range(8) for n in (1, 2, 4))
    assert got(lines.repeated_lines(df)) == want
    patterns, _ = lines.prefixspan(df, max_len=3)
    assert sorted((len(r.pattern), r.support) for r in patterns.collect()) == [(1, 6), (1, 6), (1, 6), (2, 6), (2, 6), (3, 6)]
    clean = {r.story_id: (r.clean_text, r.n_removed) for r in lines.without_repeated(df).collect()}
    assert clean[0] == ("\n--\nshort", 3) and clean[100] == ("All rights are reserved", 0) and clean[202] == (None, 0) and clean[203] == ("", 0)
    assert lines.repeated_lines(df.limit(0)).collect() == []


def brute_sequences(rows, least):
    """(story_id, line_no, n): a frequent sequence of n adjacent frequent lines ends there; one site, lines of letters only."""
    texts = {i: (u, t.split("\n")) for i, u, t in rows}

    def urls(runs):
        seen = {}
        for u, r in runs:
            seen.setdefault(r, set()).add(u)
        return {r for r, us in seen.items() if len(us) >= least}

    single = urls((u, (x,)) for u, ls in texts.values() for x in ls)
    kept = {i: (u, [(k, x) for k, x in enumerate(ls, 1) if (x,) in single]) for i, (u, ls) in texts.items()}
    out, n = set(), 1
    while True:
        runs = [(i, u, ls[e - 1][0], tuple(x for _, x in ls[e - n : e])) for i, (u, ls) in kept.items() for e in range(n, len(ls) + 1)]
        often = urls((u, r) for _, u, _, r in runs)
        if not often:
            return out
        out |= {(i, no, n) for i, _, no, r in runs if r in often}
        n += 1


def test_sequences_are_grown_to_the_end(spark, monkeypatch):
    rng = random.Random(5)
    furniture = ["all rights are reserved", "share this with friends", "read the next episode", "subscribe to our letters"]
    rows = [(i, f"u{i % 9}", "\n".join(rng.sample(furniture, rng.randint(1, 4)) + [f"a line of its own {'x' * (i + 1)}"] + furniture[: 1 + i % 4])) for i in range(24)]
    df = spark.createDataFrame([(i, u, "h", t) for i, u, t in rows], "story_id long, url string, source_host string, original_text string")
    want = brute_sequences(rows, 5)
    assert max(n for _, _, n in want) >= 4
    calls, whole = [], lines.prefixspan

    def kept(*args, **named):
        calls.append(whole(*args, **named))
        return calls[-1]

    monkeypatch.setattr(lines, "prefixspan", kept)
    found = got(lines.repeated_lines(df))
    assert len(calls) == 1
    # the query deletes by the occurrences of all levels, and these give the lines of level one
    assert {tuple(r) for r in calls[0][1].select("story_id", "line_no", "n_lines").collect()} == want
    assert found == sorted({(i, no) for i, no, _ in want}) == sorted((i, no) for i, no, n in want if n == 1)


# --- 8 --------------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, p in items:
            q = words(p)
            n = min(12, len(q))
            runs = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((d, i))
    return sorted(out)


def test_leaks(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([6, 8, 11, 12, 30])))) for i in range(12)] + [(12, ""), (13, None), (14, "w1")]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=80)
        src = words(rng.choice(items[:12])[1])
        a = rng.randrange(len(src))
        b = min(len(src), a + rng.choice([5, 11, 12, 13, 30]))
        docs.append((d, " ".join(w[:40] + [x.upper() + "," for x in src[a:b]] + w[40:])))
    docs += [(100, None), (101, ""), (102, items[0][1])]
    dd = spark.createDataFrame([(a, b, "k") for a, b in docs], "doc_id long, text string, passage string")
    ii = spark.createDataFrame(items, "item_id long, passage string")
    want = brute_leaks(docs, items)
    assert got(leaks.leaks(dd, ii)) == want
    assert got(leaks.leaks(dd, ii, block_words=60)) == want
    assert leaks.leaks(dd, ii.limit(0)).collect() == [] and leaks.leaks(dd.limit(0), ii).collect() == []
    p = " ".join(f"x{i}" for i in range(40))
    edited = " ".join("changed" if i % 9 == 4 else f"x{i}" for i in range(40))
    one = spark.createDataFrame([(1, edited)], "doc_id long, text string")
    item = spark.createDataFrame([(7, p)], "item_id long, passage string")
    assert leaks.leaks(one, item).collect() == []
    assert got(leaks.leaks(one, item, tolerant_share=0.8)) == [(1, 7, 40)]


def test_tolerant_stretch():
    a = np.array([1, 2, 3, 9, 9, 9, 9, 9, 4], np.uint64)
    b = np.array([1, 2, 3, 4, 5, 6, 7, 8, 4], np.uint64)
    best = max((j - i for i, j in combinations(range(10), 2) if (a[i:j] == b[i:j]).mean() >= 0.7), default=0)
    assert leaks._tolerant(a, b, 0, 0, 0.7) == best


def test_tolerant_placements(spark):
    """Every placement of four substitutions in 20 words is hit, and by the same rule those in other lengths."""
    for n in (5, 8, 10, 15, 16, 19, 20):
        k = n // 5
        same = np.ones((math.comb(n, k), n), bool)
        for row, at in zip(same, combinations(range(n), k)):
            row[list(at)] = False
        span = leaks.tolerant_span(n, 0.8, 20)
        runs = np.stack([same[:, i : i + span].all(1) for i in range(n - span + 1)])
        assert runs.any(0).all() and (n != 20 or len(same) == 4845)
    assert [leaks.tolerant_span(n, 0.8, 20) for n in (20, 25, 30, 300)] == [4, 4, 4, 4]
    docs = [(i, " ".join("changed" if j in at else f"x{j}" for j in range(20))) for i, at in enumerate(random.Random(2).sample(list(combinations(range(20), 4)), 300))]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    item = spark.createDataFrame([(7, " ".join(f"x{j}" for j in range(20)))], "item_id long, passage string")
    assert got(leaks.leaks(dd, item, tolerant_share=0.8)) == [(i, 7, 20) for i in range(300)]


# --- 7 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_packing_rules(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, rng.randrange(1, 60), rng.randrange(1, 300)]) for _ in range(300)]
    out = packing.pack_lengths(sizes, 100)
    room = {}
    for n, parts in zip(sizes, out):
        assert sum(k for _, k, _ in parts) == n and [p for _, _, p in parts] == list(range(len(parts)))
        assert len(parts) == max(1, -(-n // 100))
        for p, k, _ in parts:
            room[p] = room.get(p, 0) + k
    assert max(room.values()) <= 100 and set(room) == set(range(len(room)))
    assert len(room) <= -(-sum(sizes) // 100) * 1.1 + 2
    assert packing.pack_lengths([], 5) == [] and packing.pack_lengths([7], 3) == [[(0, 3, 0), (1, 3, 1), (2, 1, 2)]]


def test_packing_tables(spark):
    pytest.importorskip("tiktoken")
    c = packing.TokenCounter(packing.VOCABULARY, packing.PATTERN)
    texts = ["a b  c\n\nd", " lead", "trail ", "x  ", "", "తెలుగు కథ. don't  stop", "a\tb \n c", " x y"]
    assert [c(t) for t in texts] == [len(c.encode(t)) for t in texts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, part int")
    packed = packing.pack(packing.token_counts(df), [("s", 3), ("l", 100)], shard_rows=3)
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    for name, cap in (("s", 3), ("l", 100)):
        room = {}
        for r in rows:
            if r.pack_name == name:
                room[r.pack_id] = room.get(r.pack_id, 0) + r.n_tokens
        assert max(room.values()) <= cap
    assert packing.pack(packing.token_counts(df.limit(0)), [("s", 3)]).collect() == []


# --- 9 --------------------------------------------------------------------------------------------------


def test_kinds(spark):
    prose = "The tailor forgot the kettle, and nobody asked why. Everyone knew that she had sold it at the fair.\nHe went home by the mill road. It was late.\nNobody came to the door, though the lamp was lit.\n"
    cases = {
        "": ["", None, prose, prose.upper(), "the river runs\nslow and wide, and\nthe boats go by\nwithout a sound.\nNobody waits for\nthem any more.", '"No."\n"Yes, I think so," he said.\n"Then go."', prose + "- one\n- two\n- three\n", "A line without an end mark that goes on for a while\n" + "Another one that has many words and no end mark at all\n" * 2 + prose],
        "list": ["- one tin\n- two tins\n* a kettle\n", "1. The Red Boat\n2. old rope\n3. A Kite for Anna\n4. map", "red kite\nold rope\nThe Tin of Anna\nwet map\nlong rope\nsmall tin", "kite red, rope old, tin wet, map torn\nfan new, pot big, hat old, cup hot\n" * 2],
        "table": ["name,year,n\nanna,2020,3\nben,,4\ncal,2021,5\n", "a | b | c\n--- | --- | ---\nx | 1 | 2\ny | 3 | 4\nz | 5 | 6", "a   b    c\n12   34   56\n7    8    9\n1    22   3"],
        "junk": ["x7Gh29sKdl02mnBvQz81LpoQ9sjd8Ks02kd9sKd02\n" * 2, "tin tin tin tin tin tin tin tin\n" * 3, "%^&*#@!~~|<>{}[]\\\\//==++\n%%%^^^&&&***", "qgjk wrtp;zxcv, plkj;mnbv sdfg,hjkl trwq;zxbn lkjh", "!function(e,b){var t=725;e[2]&&t.push(n.id('a'))}(window);\n" * 2],
    }
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in cases.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert got(quality.kinds(df)) == sorted((i, k) for i, _, k in rows if k)
    judged = {r.doc_id: r for r in quality.failures(quality.shares(df)).collect()}
    assert all(judged[i].reasons == k for i, t, k in rows if t) and all(max(r.list_share, r.table_share, r.junk_share) <= 1 for r in judged.values())
    assert quality.kinds(df.limit(0)).collect() == [] and len(quality.kinds(df.unionByName(df)).collect()) == sum(k != "" for _, _, k in rows)
    stats = {r.doc_id: r for r in quality.failures(quality.statistics(df)).collect()}
    assert stats[0].n_words == 0 and "too_few_words" in stats[0].reasons and stats[1].n_words is None and stats[1].reasons == ""


# --- 2 --------------------------------------------------------------------------------------------------


def residue_rows(spark, texts, titles=None):
    rows = [(i, t, titles[i] if titles else f"Title {i}", f"https://kite-{i % 5}.example/{i}", f"kite-{i % 5}.example", "verified", "") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "story_id long, original_text string, title string, url string, source_host string, status string, error string")


def prose(seed, n=8):
    rng = random.Random(seed)
    parts = [f"{rng.choice('she he they we'.split())} {rng.choice('walked sang slept cooked hid read'.split())} by the {rng.choice('river gate hill shop mill lamp'.split())} at {x} with {rng.choice('anna ben cal dora ed'.split())}" for x in "dawn noon dusk".split()]
    return "\n\n".join(". ".join(rng.sample(parts, 3)) + f" {seed}x{k}." for k in range(n))


def test_residue(spark):
    story = " ".join(["She walked along the river and [in secret] counted the boats until the lamp went out {sighs}."] * 8)
    poem = "A poem about a kite\nand a string that was longer than the road,\nand the wind that took both of them far over the hill to the sea."
    texts = [
        "404\n\nThe page you asked for could not be found.", "Access denied", "{{ story.title }}\n{{ story.body | safe }}", story, story + "\nDear {READER_NAME}, thank you.", story.replace("river", "<%= place %>"),
        "The page you wanted could not be found, Ref: 4a5b6c", None, "", "  \n ", story + '\n"Page not found," she read from the screen.', poem, "ACCESS DENIED", story.replace("boats", "${storyTitle}"), story.replace("boats", "XXNAMEXX"),
    ]
    want = [0, 1, 2, 4, 5, 6, 12, 13, 14]
    assert [r[0] for r in got(residue.residue(residue_rows(spark, texts)))] == want
    bare = residue_rows(spark, texts).withColumns({c: F.lit(None).cast("string") for c in ("title", "url", "source_host")})
    assert [r[0] for r in got(residue.residue(bare.unionByName(bare)))] == want
    assert residue.residue(residue_rows(spark, ["x"]).limit(0)).collect() == []


def test_residue_spreads(spark):
    """Unknown wordings of more words than a stub: a component under several titles is residue, one reprinted story isn't."""
    base = "Dear reader the keeper of our old shelf has gone to the fair and locked the door so come again {} when the lamp is lit and the kettle is on"
    texts = [base.format(x) for x in ("today", "tonight", "tomorrow", "soon")]
    assert all(len(x.split()) > residue.STUB_WORDS for x in texts)
    run = lambda titles: [r[0] for r in got(residue.residue(residue_rows(spark, texts, titles), ()))]
    assert run(None) == [0, 1, 2, 3] and run(["One story"] * 4) == []
    seeded = [base.format("today") + " it is temporarily unavailable", base.format("today"), prose(7, 1) + " and the rest of it was read aloud by the old miller at night"]
    assert [r[0] for r in got(residue.residue(residue_rows(spark, seeded, ["a", "a", "b"]), ("temporarily unavailable",)))] == [0, 1]


def test_residue_long(spark):
    """Filler, dumps and notices above the length of a story are cases, inside their menus too; stories that tell of them are not."""
    rng = random.Random(6)
    filler = "\n\n".join(" ".join(rng.choices("river lantern window garden yellow silver carpet".split(), k=30)) for _ in range(3))
    dump = "Traceback (most recent call last):\n" + "\n".join(f'  File "/srv/app/views{i}.py", line {i}, in render_page\n    return self.render(request, template, context, user)' for i in range(9)) + "\nKeyError: 'story'"
    menu = ["Skip to content"] + [f"Read the terms and privacy notes of our shelf {x}" for x in "one two three four".split()] + ["Subscribe to our reading list by mail every week"] * 2
    notice = "\n".join([*menu, "The page you asked for could not be found on this server.", "It may have moved to another shelf of the house.", "Copyright, all rights reserved, no part may be copied"])
    stories = ["\n".join([*menu, prose(i), "Copyright, all rights reserved, no part may be copied"]) for i in range(6)]
    told = prose(50) + '\n"Page not found," Mira read aloud from the broken screen, and all laughed.'
    assert all(len(x.split()) > residue.STORY_WORDS for x in (filler, dump, notice, told, *stories))
    assert [r[0] for r in got(residue.residue(residue_rows(spark, [filler, dump, notice, told, *stories])))] == [0, 1, 2]


def test_residue_needs_few_phrases(spark):
    """Without any phrase hardly a row is lost: labels come from counts and components."""
    stories = table(spark, "/root/testdata/sf0.01", "stories")
    whole, bare = ({r[0] for r in residue.residue(stories, seeds).collect()} for seeds in (residue.SEEDS, ()))
    assert len(whole) > 20 and len(bare & whole) >= 0.95 * len(whole)


def test_residue_links(spark):
    """The links against brute force: short edits of short messages; the recall is that of the tables."""
    rng = random.Random(4)
    texts = []
    for n, edits in ((8, 1), (10, 1), (16, 2), (20, 3), (30, 5)):
        for k in range(40):
            w = [f"w{n}x{k}x{i}" for i in range(n)]
            v = list(w)
            for i in rng.sample(range(n), edits):
                v[i] += "changed"
            texts += [" ".join(w), " ".join(v)]
    hasher, rows, sets = WordHasher(), [], []
    for i, t in enumerate(texts):
        h = np.unique(hasher(residue.normal(t)))
        sets.append(set(h.tolist()))
        rows.append((i, len(h), False, bytearray(residue.simhash(residue.mix(h)).tobytes()), bytearray(h.tobytes())))
    want = {(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= residue.MIN_SIMILARITY * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "m long, n int, story boolean, fp binary, set binary")
    found = set(got(residue.links(df)))
    assert len(want) > 150 and found <= want and len(found) >= 0.97 * len(want)
    assert residue.miss_probability(0.6) < 0.03 and residue.miss_probability(0.8) < 1e-5


def test_residue_bucket_blocks(spark, monkeypatch):
    monkeypatch.setattr(residue, "MAX_BUCKET", 3)
    h = np.unique(WordHasher()([f"w{i}" for i in range(20)]))
    rows = [(i, 20, i > 4, bytearray(residue.simhash(residue.mix(h)).tobytes()), bytearray(h.tobytes())) for i in range(9)]
    df = spark.createDataFrame(rows, "m long, n int, story boolean, fp binary, set binary")
    assert got(residue.links(df)) == [(a, b) for a, b in combinations(range(9), 2) if a <= 4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    df = spark.createDataFrame(chain, "a long, b long")
    labels = dict(got(residue.components(df)))
    assert {labels[i] for i in range(41)} == {0} and {labels[i] for i in (100, 101, 102)} == {100}


# --- 4 --------------------------------------------------------------------------------------------------


def near_texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocab, k=rng.choice([60, 120, 300])) for _ in range(25)]
    rows, k = [], 0
    for t in base:
        for edits in (0, 0, 2, 6, 15, 40):
            w = list(t)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            k += 1
            rows.append((k, f"u{k}", rng.choice(["", None, f"h{k}", "same"]), " ".join(w)))
    return rows + [(900, "u900", "x", None), (901, "u901", "x", ""), (902, "u902", "x", "short text"), (903, rows[0][1], "y", rows[0][3]), (904, None, None, rows[0][3])]


def brute_pairs(rows, t, size, least):
    sets = [(i, u, h, set(zip(*[words(x)[k:] for k in range(size)]))) for i, u, h, x in rows if len(words(x)) >= least]
    out = []
    for a, b in combinations(sets, 2):
        if len(a[3] & b[3]) >= t * len(a[3] | b[3]) and (a[1] is None or b[1] is None or a[1] != b[1]) and (not a[2] or not b[2] or a[2] != b[2]):
            out.append((min(a[0], b[0]), max(a[0], b[0])))
    return sorted(out)


@pytest.mark.parametrize("shard", [512, 4])
def test_near_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(neardup, "MAX_SHARD", shard)
    monkeypatch.setattr(neardup, "CLASS_BLOCK", max(2, shard // 2))
    rows = near_texts()
    df = spark.createDataFrame(rows, "story_id long, url string, raw_sha256 string, original_text string")
    assert got(neardup.pairs(df)) == brute_pairs(rows, 0.6, 3, 50)
    assert neardup.pairs(df.limit(0)).collect() == []


def test_near_groups(spark):
    rows = near_texts()
    df = spark.createDataFrame(rows, "story_id long, url string, raw_sha256 string, original_text string")
    out = {r.story_id: r.group_id for r in neardup.groups(df).collect()}
    assert set(out) == {i for i, _, _, _ in rows} and out[900] == 900 and out[901] == 901
    same = [(a, b) for a, b in brute_pairs([(i, None, None, x) for i, _, _, x in rows], 0.8, 5, 5)]
    assert same and all(out[a] == out[b] for a, b in same)
    links = {frozenset((out[a], out[b])) for a, b in combinations(out, 2) if out[a] == out[b]}
    assert len(links) < len(out)


def test_tree_and_bound():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        for cut in (0, 5, 30, 90):
            sets.append(np.unique(np.concatenate((base[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)))))
    fp = np.array([neardup.odd_sketch(s) for s in sets])
    size = np.array([len(s) for s in sets])
    for a, b in combinations(range(len(sets)), 2):
        if a // 4 == b // 4:  # the bound: the sketch never tells two sets further apart than they are
            assert np.bitwise_count(fp[a] ^ fp[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
    tree = neardup.VantageTree(fp, size)
    for q in range(0, len(sets), 7):
        want = np.flatnonzero(np.bitwise_count(fp ^ fp[q]).sum(1) <= neardup.radius(0.6, size, size[q]))
        assert sorted(tree.query(fp[q], size[q], 0.6)) == want.tolist()


# --- 3 --------------------------------------------------------------------------------------------------


def test_languages(spark):
    docs, stories = table(spark, DIR, "documents"), table(spark, DIR, "stories")
    contents = language.fit(docs, stories)
    c = language.Classifier(contents)
    en = "The tailor forgot the kettle on the ferry deck, and nobody asked why she had sold it."
    te = "పెద్ద కాఫీ గురించి వేబజో పొద్దున్నే గుడిముందు భయంగా అడిగారు, ఆ మాట విని ఆగిపోయారు."
    latn = "Chivariki snehitudu totalo kotta pustakam rahasyangaa daachipettindi, kaanee evarikee cheppaledu."
    hi = "दादी ने नदी के पास पुरानी तस्वीर देखी, पर किसी को नहीं बताया और सब चुप रहे।"
    for text, lang in ((en, "en"), (te, "te"), (latn, "te_latn"), (hi, "hi"), (en.upper(), "en")):
        assert language.label_text(text, c)[0] == lang
    lang, sure, ls = language.label_text(f"{en}\n\nshort\n{te}\n{te}", c)
    assert lang == "te" and [(n, x) for n, x, _ in ls] == [(1, "en"), (3, "te"), (4, "te")] and 0 < sure < 1
    assert language.label_text("", c) is None and language.label_text("short one", c) is None
    rows = [(1, 1, te), (2, 0, te), (3, None, en), (4, 0, en), (5, 0, f"{en}\n{te}"), (6, 1, None), (7, 1, ""), (8, 1, latn)]
    df = spark.createDataFrame([(a, b, t, "x") for a, b, t in rows], "story_id long, telugu int, original_text string, lang string")
    out = got(language.relabel(language.languages(df, contents)).select("story_id", "line_no", "lang"))
    assert [x for x in out if x[0] != 5] == [(2, 0, "te"), (3, 0, "en")] and {x[1:] for x in out if x[0] == 5 and x[1]} == {(1, "en"), (2, "te")}


def test_language_rejects_narrow_margins(spark):
    """No confidence is certain; what no dictionary knows is rejected, and a language without a sample keeps its script."""
    docs, stories = table(spark, DIR, "documents"), table(spark, DIR, "stories")
    c = language.Classifier(language.fit(docs, stories))
    known = language.label_text("The tailor forgot the kettle on the ferry deck, and nobody asked why she had sold it.", c)
    strange = language.label_text("Zqxv wplkt mnbvr zzkqj xvwpl ktmnb vrzzk qjxvw plktm nbvrz zkqjx vwplk tmnb", c)
    assert 0.5 < known[1] < 1 and strange[1] < 0.5
    empty = language.Classifier({})
    assert language.label_text("పెద్ద కాఫీ గురించి వేబజో పొద్దున్నే గుడిముందు భయంగా అడిగారు.", empty)[0] == "te"
    assert language.fit(docs.limit(0), stories.limit(0)) == {}


def test_language_accuracy(spark):
    """Held-out labelled documents: nearly all clearly labelled lines agree with their document."""
    docs, stories = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "stories")
    c = language.Classifier(language.fit(docs, stories, sample_rows=400))
    held = docs.where("lang in ('en', 'te', 'hi', 'te_latn') and doc_id % 7 = 0 and n_chars between 300 and 3000").select("lang", "text").collect()
    ok = sum(language.label_text(t, c)[0] == lang for lang, t in held if language.label_text(t, c))
    assert ok >= 0.85 * len(held)  # some labels are wrong, some texts no prose


def test_recurring_lines_cover_all_rows(spark):
    rows = [(i, f"Line of its own {'abcdefghij'[i % 10]}{i // 10}\nShare this, friends!\n\nSHARE THIS  friends {i}") for i in range(5)] + [(9, None), (10, "")]
    assert language.recurring_lines(spark.createDataFrame(rows, "story_id long, original_text string")) == ["SHARE THIS  friends 0"]


# --- 1 --------------------------------------------------------------------------------------------------


def test_leaves():
    ls = boilerplate.leaves("<html><head><title>T</title></head><body><nav><li>Home &amp; more</li></nav><div><h1>T</h1>one<br>two <b>bold</b><p>three</div><script>x</script></p>tail")
    assert [x[1] for x in ls] == ["Home & more", "T", "one", "two", "bold", "three", "tail"]
    assert len({x[0] for x in ls if x[1] in ("one", "three", "T")}) == 1
    assert boilerplate.leaves("") == [] and [x[1] for x in boilerplate.leaves("plain <b>text")] == ["plain", "text"]
    beside = boilerplate.leaves("<body><p>menu</p><div><h1>T</h1><p>one</p></div></body>")
    assert len({x[2] for x in beside}) == 2 and beside[0][0].startswith("/body/p")


def test_boilerplate(spark):
    rng = random.Random(2)
    pages, stories = [], []
    sites = ["kite-tales-1.example", "mango-shelf-2.example", "river-pages-3.example"]
    for i in range(45):
        host = sites[i % 3]
        name = " ".join(w.capitalize() for w in boilerplate.site_name(host).split())
        title = f"The {rng.choice(['red', 'old', 'wet'])} boat {i}"
        paras = [" ".join(rng.choices([a + b + c for a in "bdfgklmn" for b in "aeiou" for c in "lmnrst"], k=25)) + "." for _ in range(4)]
        inner = [f"By Anna{i} for {name}", paras[0], paras[1], "* * *", paras[2], f"Exclusive to {name}. All rights reserved.", paras[3]]
        top, foot, other = ["Home | Stories | Contact"], [f"Copyright 2020 by {name} | Terms | Privacy"], ["Related stories", f"The tin of {i + 7}"]
        html = f"<html><head><title>{title}</title></head><body><nav><li>{top[0]}</li></nav><div class=x{i}><h1>{title}</h1>{'<br><br>'.join(inner)}</div><div><p>{other[0]}</p><p>{other[1]}</p></div><footer><p>{foot[0]}</p></footer></body></html>"
        pages.append((i, f"f{i}", f"https://{host}/{i}", html, f"s{i}"))
        lines_ = [*top, title, *inner, *other, *foot]
        bad = [k for k, x in enumerate(lines_, 1) if x in top + other + foot or x.startswith("Exclusive")]
        stories.append((i, f"https://{host}/{i}", title, host if i % 5 else None, f"f{i}", f"s{i}" if i != 44 else None, "\n\n".join(lines_), bad))
    p = spark.createDataFrame(pages + [(99, None, None, None, None)], "page_id long, raw_file string, url string, html string, raw_sha256 string")
    s = spark.createDataFrame([x[:7] for x in stories] + [(90, None, None, None, None, None, None), (91, "u", "t", "h", "", "", "")], "story_id long, url string, title string, source_host string, raw_file string, raw_sha256 string, original_text string")
    want = sorted((x[0], n) for x in stories if x[0] != 44 for n in x[7])
    found = got(boilerplate.boilerplate(s, p))
    assert [x for x in found if x[0] != 44] == want
    assert {n for i, n in found if i == 44} >= {1, 8}  # without its page the row's furniture is known from the others
    assert boilerplate.boilerplate(s.limit(0), p.limit(0)).collect() == []


def test_lines_find_their_page(spark):
    """Nearly all lines of rows with a page equal a leaf of it, and the tree decides on them."""
    d = "/root/testdata/sf0.01"
    found = boilerplate.matched(table(spark, d, "stories"), table(spark, d, "raw_pages")).cache()
    keys = table(spark, d, "raw_pages").select(boilerplate.page_key().alias("page"))
    with_page = found.join(keys, "page", "left_semi").agg(F.count(F.lit(1)), F.count("keep")).first()
    assert with_page[0] > 5000 and with_page[1] >= 0.95 * with_page[0]
    off = found.where("not keep").count()
    assert off > 0.5 * boilerplate.boilerplate(table(spark, d, "stories"), table(spark, d, "raw_pages")).count()


# --- all of them on the smallest tables -----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, DIR)
    assert df.columns and df.count() >= 0


def test_only_wanted_texts_are_moved(spark):
    rows = spark.range(4000).select(F.col("id").alias("story_id"), F.lit("a text").alias("original_text"))
    ids = rows.where("story_id % 100 = 7").select("story_id")
    kept = {r.story_id for r in residue._wanted(rows, ids).collect()}
    assert kept >= set(range(7, 4000, 100)) and len(kept) < 400
    assert residue._wanted(rows, ids.limit(0)).collect() == []


def test_signs_equal_the_patterns(spark):
    slots = ["{{ name }}", "<% x %>", "${x}", "#{x}", "[[a b]]", "[% x %]", "{% x %}", "__NAME__", "%%x%%", "%NAME%", "@@x@@", "<<x>>", "{A_B}", "{a_b}", "{12}", "xXNAMEXx", "[object Object]", "[your name]", "[TITLE]", "XXI", "50 %", "[a]"]
    dumps = ["  at a.b(c", '  File "a.py", line 3', "Caused by: x", "... 12 more", "#1 /a/b:", "a.ValueError: x", "x.Exception", "in /a on line 3", "2024-01-02T03:04:05 x WARNING y", "2024-01-02 03:04 INFO", "[error] x", "[warn: x", "[crit] x", "Traceback (most"]
    dumps += ["look at me (now", "errors", "line 3", "2024-01-02 03:04 said", "and more"]
    texts = [*slots, *dumps, *residue.SEEDS, *map(str.upper, residue.SEEDS), "was found", "an error", "lorem", "dolor", "a plain line of a story"]
    own = residue.rows_with_lines(spark.createDataFrame([(i, f"t{i}", "u", "h", t) for i, t in enumerate(texts)], "story_id long, title string, url string, source_host string, original_text string"))[0]
    got_ = {r.story_id: (r.slot, r.signs) for r in own.collect()}
    plain = spark.createDataFrame(list(enumerate(texts)), "story_id long, t string")
    said = F.lower("t").rlike("|".join([*residue.SEEDS, "lorem", "dolor"]))
    plain = plain.select("story_id", F.col("t").rlike("(?i)" + residue.SLOT).alias("slot"), (said | F.col("t").rlike("(?m)" + residue._DUMP.pattern)).alias("signs"))
    assert got_ == {r.story_id: (r.slot, r.signs) for r in plain.collect()} and len({x for x in got_.values()}) >= 3


def test_what_a_line_says():
    for raw in ["Home | Log in  now", "ALL RIGHTS — 2024, My Site", "తెలుగు కథ: my site", "İstanbul K", "x" * 200 + " My Site, and on", "...", "12"]:
        text = boilerplate.flat(raw)
        letters = " ".join(boilerplate.NOT_LETTER.sub(" ", text.lower()).split())
        c = letters.replace("my site", "§")
        want = (boilerplate._hash(text), boilerplate._hash("h|" + c), boilerplate._hash(c), boilerplate.parts(raw, c), boilerplate.line_bits(text, "", c), text)
        assert boilerplate._letters(text) == letters and boilerplate._told(raw, "my site", "h") == boilerplate._short(raw, "my site", "h") == want
    rows = [(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, [1, 2]), (-(1 << 63), 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, [])]
    assert [tuple(r.values()) for r in boilerplate._batch(rows, boilerplate._LEAF).to_pylist()] == rows
    assert boilerplate._batch([], boilerplate._LINE).num_rows == 0
