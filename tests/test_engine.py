"""The callable operators on small scenarios with known answers."""

import difflib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from newsloom.api import News
from newsloom.functions import recover, stem
from newsloom.operators import budget, context, crawl, identity, intersection, keywords, lineage, search, trust
from newsloom.sources import feeds, registry
from newsloom.storage import fresh_path
from newsloom.streaming import ingest, windows
from newsloom.versioned import VersionedTable, rebuild


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_match_scores(spark):
    cases = {"donald trump": 1.0, "president donald trump jr": 0.95, "trump": 0.95, "donald duck": 0.875, "a b c donald": None, "other": None}
    role = spark.createDataFrame([(i, n) for i, n in enumerate(cases)], "role_id int, norm string")
    got = {r.norm: r.score for r in intersection.match_roles(role, ["Donald Trump"]).collect()}
    assert got == {n: s for n, s in cases.items() if s is not None}
    assert intersection.match_roles(role, []).count() == 0


@pytest.fixture(scope="module")
def news(spark):
    member = spark.createDataFrame(
        [(1, 11, "reuters", "2024-01-01 10:00:00", 1704103200, "t1", 1), (1, 12, "cnn", "2024-01-02 10:00:00", 1704189600, "t2", 2), (2, 21, "blog", None, None, "t3", 1), (3, 31, "fox", "2024-01-03 00:00:00", 1704240000, "t4", 1)],
        "cluster_id long, article_id long, source_id string, event_ts string, event_sec long, title string, rn long",
    )
    role = spark.createDataFrame([("w1", "donald trump", 11), ("p1", "disney world", 12), ("w1", "donald trump", 21), ("x", "speech", 31)], "role_id string, norm string, article_id long")
    known = spark.createDataFrame([("reuters", 0.9), ("cnn", 0.7), ("fox", 0.4)], "source_id string, trust double")
    return member, role, known


def test_find_narratives(spark, news):
    find = lambda texts, **o: [r.cluster_id for r in intersection.find_narratives(*news, texts, 1704326400, **o).collect()]
    assert find(["Donald Trump", "Disney World"]) == [1]
    assert find(["Donald Trump", "Disney World"], require_all=False) == [1, 2]
    assert find(["Donald Trump", "nobody at all"]) == [] and find([]) == [] and find(["nobody at all"], require_all=False) == []
    assert find(["Donald Trump"], min_trust=0.6) == [1] and find(["Donald Trump"], ranking="recency", limit=1) == [1]
    frames = spark.createDataFrame([(1, True)], "cluster_id long, shifted boolean")
    assert find(["Donald Trump"], ranking="frame", frames=frames) == [2, 1] and find(["Donald Trump"], ranking="unknown") == [1, 2]
    top = intersection.find_narratives(*news, ["Donald Trump"], 1704326400).collect()
    assert [(r.trust_score, r.days, r.source_count) for r in top] == [(0.8, 1, 2), (0.5, 9999, 1)]


def test_context(spark, news):
    articles = spark.createDataFrame([(11, "p one\n\np two"), (12, "only"), (31, "x")], "article_id long, text string")
    got = context.materialize_context(news[0], articles, news[2], [1, 99])
    assert _rows(got.paragraphs, "article_id", "paragraph") == [(11, "p one"), (11, "p two"), (12, "only")]
    assert got.totals.first().asDict() == {"total_articles": 2, "total_sources": 2}
    assert got.text.first().context == "--- Narrative: t1 (sources: cnn, reuters) ---\n\n[reuters] p one\n\np two\n\n[cnn] only"
    assert context.materialize_context(news[0], articles, news[2], []).narratives.count() == 0


def test_merge_of_roles_everywhere(spark):
    role = spark.createDataFrame([("k", "Trump", ["s1"], []), ("r1", "DJT", ["s2", "s1"], []), ("r2", "Donald", ["s3"], []), ("z", "other", ["s9"], [])], "role_id string, text string, references array<string>, merged_from array<string>")
    merges = spark.createDataFrame([("r1", "k"), ("r2", "k"), ("k", "k"), ("z", "unknown"), ("nobody", "k")], "old_id string, new_id string")
    remap = identity.resolve(merges, role)
    assert _rows(remap, "old_id", "new_id") == [("r1", "k"), ("r2", "k")]
    out = identity.merge_roles(role, remap)
    want = [("k", "Trump", ["s1", "s2", "s3"], 3, ["r1", "r2"], True), ("z", "other", ["s9"], 1, [], False)]
    columns = ("role_id", "text", "references", "reference_count", "merged_from", "is_association")
    assert _rows(out, *columns) == want
    again = identity.merge_roles(out, identity.resolve(merges, out))  # r1 and r2 are gone: nothing to do
    assert _rows(again, *columns) == want and identity.resolve(merges.limit(0), role).count() == 0
    lists = spark.createDataFrame([(1, ["r1", "z", "k"]), (2, []), (3, None)], "id long, ids array<string>")
    assert _rows(identity.merge_lists(lists, "id", "ids", remap), "id", "ids") == [(1, ["k", "z"]), (2, []), (3, [])]
    rels = spark.createDataFrame([("k", "z", 2), ("r1", "z", 3), ("k", "r2", 1)], "a string, b string, weight long")
    assert _rows(identity.merge_edges(rels, remap), "a", "b", "weight") == [("k", "z", 5)]
    links = spark.createDataFrame([("z", "r1", 0.5), ("k", "z", 0.9)], "a string, b string, confidence double")
    assert _rows(identity.merge_links(links, remap, "who"), "a", "b", "confidence") == [("k", "z", 0.9)]
    seen = spark.createDataFrame([("r1", "r2", "same"), ("y", None, "no")], "a string, b string, verdict string")
    assert _rows(identity.merge_observations(seen, remap), "a", "b") == [("k", "k"), ("y", None)]


def test_proposals_equal_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    norms = sorted({" ".join(rnd.sample(words, rnd.randint(1, 5))) for _ in range(150)})
    rows = [(i, "who" if i % 7 else "what", n) for i, n in enumerate(norms)]
    got = {(r.a, r.b) for r in identity.propose(spark.createDataFrame(rows, "id long, role string, norm string")).where("overlap >= 0.5").collect()}
    sets = [(i, role, set(n.split())) for i, role, n in rows]
    assert got == {(a, b) for a, ra, x in sets for b, rb, y in sets if a < b and ra == rb and 2 * len(x & y) >= max(len(x), len(y))}
    near = spark.createDataFrame([(1, "who", "smithson"), (2, "who", "smithsen"), (3, "what", "smithson"), (4, "who", "")], "id long, role string, norm string")
    assert _rows(identity.propose(near), "a", "b") == [(1, 2)]


def test_trust(spark):
    member = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "a"), (2, 4, "c"), (3, 5, "d")], "cluster_id long, article_id long, source_id string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 1.0])], "article_id long, x array<float>")
    base = spark.createDataFrame([("a", 0.5), ("b", 0.98), ("c", 0.05), ("d", 0.3)], "source_id string, trust double")
    out = trust.update(base, trust.agreement(member, vectors))
    assert _rows(out, "source_id", "related", "agreeing", "contradicting", "adjusted_trust") == [("a", 2, 1, 1, 0.5), ("b", 1, 1, 0, 1.0), ("c", 1, 0, 1, 0.0), ("d", 0, 0, 0, 0.3)]
    assert [r.source_id for r in trust.board(out).collect()] == ["b", "a", "d", "c"]
    last = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 2)], "source_id string, trust double, at int")
    assert _rows(trust.latest(last, "at"), "source_id", "trust") == [("a", 0.2)]


def test_crawl_is_bounded(spark):
    links = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("a", "s"), ("a", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("s",), ("s",), (None,)], "node string")
    go = lambda depth, pages, rule=None: _rows(crawl.crawl(links, seeds, depth, pages, rule), "node", "depth")
    assert go(0, 10) == [("s", 0)] and go(1, 10) == [("a", 1), ("b", 1), ("c", 1), ("s", 0)]
    assert go(9, 10) == [("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("s", 0)] and go(9, 3) == [("a", 1), ("b", 1), ("s", 0)]
    assert go(9, 10, F.col("node") != "d") == [("a", 1), ("b", 1), ("c", 1), ("s", 0)] and crawl.crawl(links, seeds.limit(0), 3, 3).count() == 0
    rules = crawl.robots_rules(spark.createDataFrame([("h", "User-agent: x\nDisallow: /x\nUser-agent: a\nUser-agent: *\nDisallow: /p # no\nDisallow:\n"), ("o", "")], "host string, text string"))
    assert _rows(rules, "host", "prefix") == [("h", "/p")]
    pages = spark.createDataFrame([("http://h/p/1",), ("http://H/x",), ("http://o/p",), ("nothing",)], "url string")
    assert _rows(crawl.may_fetch(pages, rules), "url") == [("http://H/x",), ("http://o/p",)]


RSS = """<?xml version="1.0"?><rss xmlns:media="m" xmlns:content="c" xmlns:dc="d"><channel><title>T</title>
<item><title>One</title><link>https://youtu.be/ab-1</link><description>Sum</description><content:encoded><![CDATA[Body &]]></content:encoded>
<pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><dc:creator>Ann</dc:creator><media:content url="http://a/v" medium="video"/><media:content url="http://a/1.JPG"/></item>
<item><title>Blank</title><link>http://a/2</link><description> </description></item>
<item><title>Old</title><link>http://a/3</link><description>D3</description><pubDate>Fri, 01 Dec 2023 10:00:00 GMT</pubDate></item>
<item><title>Thumb</title><link>http://a/4</link><description>D4</description><media:group><media:thumbnail url="http://a/g"/></media:group><enclosure url="http://a/e" type="image/png"/></item>
<item><title>Sound</title><link>http://a/5</link><description>D5</description><enclosure url="http://a/e.mp3" type="audio/mpeg"/><media:content url="http://a/w" type="video/mp4"/></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed><entry><title>Six</title><link rel="self" href="http://a/self"/><link rel="alternate" href="http://a/6"/><summary>S6</summary><author><name>Bo</name></author><updated>2024-01-05T00:00:00Z</updated></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    rows = {r.title: r for r in feeds.read_feed(spark, str(tmp_path), "wire", since="2024-01-01").collect()}
    assert set(rows) == {"One", "Thumb", "Sound", "Six"}  # blank texts go, undated ones stay
    assert rows["One"].text == "Sum\n\nBody &" and rows["One"].author == "Ann" and rows["One"].image_url == "http://a/1.JPG"
    assert rows["One"].video_url == "https://www.youtube.com/embed/ab-1" and rows["Thumb"].image_url == "http://a/g"
    assert rows["Sound"].image_url is None and rows["Sound"].video_url == "http://a/w"
    assert (rows["Six"].url, rows["Six"].text, rows["Six"].author) == ("http://a/6", "S6", "Bo")


def test_article_files_and_logs(spark, tmp_path):
    one, schema = {"title": "t", "text": "x"}, "title string, text string"
    bodies = {"a.jsonl": json.dumps(one) + "\n\n" + json.dumps(one) + "\n", "b.json": json.dumps([one, one]), "c.json": json.dumps({"articles": [one, one, one]}), "d.json": json.dumps(one, indent=1)}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    assert [feeds.read_articles(spark, str(tmp_path / n), schema).count() for n in bodies] == [2, 2, 3, 1]
    (tmp_path / "log.jsonl").write_text('{"cos": 0.5}\n\n{"cos": \nnot json\n{"cos": 0.7}\n')
    assert _rows(feeds.read_log(spark, str(tmp_path / "log.jsonl"), "cos double"), "cos") == [(0.5,), (0.7,)]


def test_search_results(spark):
    schema = "n int, url string, title string, content string, publishedDate string, metadata string, img_src string, thumbnail string, image string"
    rows = [(0, "http://www.a.b/1", "T", "", " ", "1h | NBC", "data:x", "http://t", None), (1, "http://www.a.b/1", "again", "x", None, None, None, None, None), (2, "ftp://x", "T", "c", None, None, None, None, None), (3, "http://a.b/3", " ", None, None, None, None, None, None)]
    page = spark.createDataFrame(rows, schema)
    got = feeds.search_articles(page).collect()
    assert [(r.url, r.title, r.published, r.author, r.image_url, r.source_id) for r in got] == [("http://www.a.b/1", "T", None, "NBC", "http://t", "a.b")]
    assert [r.n for r in feeds.paged([page, page], 5).collect()] == [0, 1, 2, 3, 0]


def test_registry(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps({"reuters": {"base_trust": 0.9, "name": "Reuters"}, "blog": {}, "feeds": {"reuters": "http://r"}, "searxng": {"url": "http://s"}, "note": "text"}))
    known = registry.load(spark, str(path))
    assert _rows(known, "source_id", "name", "base_trust") == [("blog", "blog", 0.5), ("reuters", "Reuters", 0.9)]
    assert registry.load(spark, str(tmp_path / "none")).count() == 0 and registry.search_provider(spark, str(path)) == {"url": "http://s"}
    assert registry.setting(spark, str(path), "feeds") == {"reuters": "http://r"} and registry.setting(spark, str(tmp_path / "none"), "feeds") == {}
    more = registry.ensure(known, spark.createDataFrame([("reuters", 0.1), ("npr", 0.8), ("npr", 0.8)], "source_id string, base_trust double"))
    registry.save(more, str(tmp_path / "saved"))
    assert _rows(registry.load(spark, str(tmp_path / "saved")), "source_id", "base_trust") == [("blog", 0.5), ("npr", 0.8), ("reuters", 0.9)]
    asked = spark.createDataFrame([("npr",), ("x",)], "source_id string")
    assert _rows(registry.base_trust(asked, more, 0.3), "source_id", "base_trust") == [("npr", 0.8), ("x", 0.3)]
    assert registry.overlay({"a": "1", "b": "2"}, ["b=http://x?y=z", "broken"]) == {"a": "1", "b": "http://x?y=z"}


def test_recovery_of_json():
    cases = {'{"a": 1}': '{"a": 1}', '<think>{"a": 0}</think> so {"a": {"b": 2}} ok': '{"a": {"b": 2}}', "{bad} {\"x\": 1} {worse}": '{"x": 1}', "[1, 2]": "[1, 2]", "none": None, "} {": None, None: None, "{{bad} {\"q\": 1}": '{"q": 1}'}
    assert {t: recover.last_object(t) for t in cases} == cases
    assert recover.last_object("{" * 200_000 + "}" * 200_000) is None


def test_titles_equal_brute_force(spark, sf):
    rows = lineage.articles(spark, sf).select(F.col("article_id").alias("id"), "source_id", "title")
    known = rows.where("id % 2 = 0")
    new = rows.where("id % 2 = 1").unionByName(known.limit(40).withColumn("id", F.col("id") + 100_001).withColumn("title", F.upper("title")))
    old = {}
    for r in sorted(known.collect()):
        if r.title:
            old.setdefault(r.source_id, []).append(r.title.lower().strip())
    want = {r.id for r in new.collect() if not (r.title and any(difflib.SequenceMatcher(None, r.title.lower().strip(), o).ratio() >= 0.85 for o in old.get(r.source_id, [])[:50]))}
    got = recover.new_titles(new, known.select("source_id", "title", F.col("id").alias("at")))
    assert {r.id for r in got.collect()} == want and len(want) < new.count()


def test_versions_and_crashes(spark):
    store = VersionedTable(spark, fresh_path(spark, "t"))
    assert store.version() is None
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    store.replace(rows)
    store.write(rows.limit(0))  # died before the pointer moved
    assert store.read().count() == 3
    delta = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (4, "d", 1)], "id long, v string, at int")
    for _ in range(2):
        store.upsert(delta, "id", "at")
        assert _rows(store.read(), "id", "v") == [(1, "a"), (2, "new"), (3, "c"), (4, "d")]
    store.delete(delta.where("id = 4"), "id")
    store.compact(1)
    assert store.vacuum() > 3 and store.read().count() == 3 and len(store.read().inputFiles()) == 1
    assert _rows(rebuild(store, rows.where("id <> 1"), "id"), "id") == [(1,)] and store.read().count() == 2


def test_stream_resumes_and_repeats_nothing(spark, tmp_path):
    source, target, ticks = tmp_path / "in", VersionedTable(spark, fresh_path(spark, "s")), []
    source.mkdir()
    start = lambda: ingest.ingest(spark, str(source), "url string, text string", target, str(tmp_path / "cp"), on_new=lambda b, n: ticks.append((n, b.count()))).awaitTermination()
    page = lambda i: json.dumps({"url": f"http://a/{i}", "text": f"{i} " * 30})
    (source / "1.json").write_text("\n".join([page(1), page(2), page(1), json.dumps({"url": "http://a/short", "text": "x"}), json.dumps({"url": "http://msn.com/1", "text": "y" * 90}), "{broken"]))
    start()
    (source / "2.json").write_text("\n".join([page(2), page(3)]))
    start()
    start()
    assert _rows(target.read(), "url") == [("http://a/1",), ("http://a/2",), ("http://a/3",)] and [n for _, n in ticks] == [2, 1]
    assert ingest.cap(3, 50) == 200 and ingest.cap(30, 50) == 50


def test_stream_keeps_the_longest_text_of_a_url(spark, tmp_path):
    source, target, ticks = tmp_path / "in", VersionedTable(spark, fresh_path(spark, "s")), []
    source.mkdir()
    start = lambda: ingest.ingest(spark, str(source), "url string, text string", target, str(tmp_path / "cp"), on_new=lambda b, n: ticks.append(b.count())).awaitTermination()
    page = lambda i, n: json.dumps({"url": f"http://a/{i}", "text": "x" * n})
    (source / "1.json").write_text("\n".join(page(i, n) for n in (50, 90, 70) for i in range(20)))
    start()
    (source / "2.json").write_text("\n".join([page(0, 60), page(1, 120), page(2, 90), page(20, 40)]))
    start()
    assert _rows(target.read().select("url", F.length("text").alias("n")), "url", "n") == sorted([(f"http://a/{i}", {1: 120, 20: 40}.get(i, 90)) for i in range(21)], key=str)
    assert ticks == [20, 2]


def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, 1704067200 + i * 1700) for i in range(200)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    query = windows.counts(stream, "ts", ["k"], "6 hours", "2 hours", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert _rows(spark.table("w"), "start", "k", "n") == _rows(windows.counts(rows, "ts", ["k"], "6 hours", "2 hours"), "start", "k", "n")
    gaps = windows.sessions(spark.createDataFrame([(1, 0), (1, 50), (1, 200)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")), "ts", ["k"], "60 seconds")
    assert sorted(r.n for r in gaps.collect()) == [1, 2]


def test_rows_a_whole_gap_apart_are_two_sessions(spark):
    rows = spark.createDataFrame([(1, 0), (1, 59), (1, 119), (2, 7)], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = windows.sessions(rows, "ts", ["k"], "60 seconds").select("k", F.unix_micros("start").alias("a"), F.unix_micros("end").alias("b"), "n")
    assert _rows(got, "k", "a", "b", "n") == [(1, 0, 119_000_000, 2), (1, 119_000_000, 179_000_000, 1), (2, 7_000_000, 67_000_000, 1)]


def test_search(spark):
    rows = [(1, "2024-01-01", "Été", "the north-west wind and rain"), (2, "2024-01-02", "x", "west north rain rain"), (3, "2024-01-03", "y", "sun"), (3, "2024-01-02", "old", "rain"), (4, "2024-01-04", "z", "wind sun sun"), (5, "2024-01-04", "u", "fog")]
    postings = search.index(spark.createDataFrame(rows, "article_id long, published string, title string, text string"))
    docs = search.catalogue(postings)
    kept, kept_docs = search.stored(spark.createDataFrame(rows, "article_id long, published string, title string, text string"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, postings.collect()))
    assert sorted(map(tuple, kept_docs.collect())) == sorted(map(tuple, docs.collect()))
    ids = lambda *a, **k: [r.article_id for r in search.search(postings, docs, *a, **k).hits.collect()]
    assert ids("rain") == [2, 1] and ids("north-west") == [1] and ids("ete") == [1] and ids("ÉTÉ zz") == [1] and ids("!! ??") == []
    assert ids("") == [4, 5, 3, 2, 1] and ids("", page=2, limit=2) == [3, 2] and ids("sun", range_name="yesterday", today="2024-01-04") == [3]
    found = search.search(postings, docs, "rain sun", limit=2)
    assert (found.total, found.total_pages) == (4, 2) and search.search(postings, docs, "nothing").total_pages == 0


def _fts5(rows, columns):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5({columns}, tokenize='porter unicode61')")
    con.executemany(f"INSERT INTO t(rowid, {columns}) VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con


def test_stems_equal_sqlite(spark):
    rnd = random.Random(3)
    ends = [*stem.SECOND, *stem.THIRD, *stem.FOURTH, "s", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", ""]
    words = {"".join(rnd.choices("aeiouybcdlstzxwrgn", k=rnd.randrange(6))) + rnd.choice(ends) + rnd.choice([*ends, *[""] * 30]) for _ in range(20000)}
    words = sorted(words - {""}) + ["caresses", "ponies", "relational", "hopping", "sky", "is", "x" * 63 + "s", "x" * 64 + "s", "новости"]
    con = _fts5(list(enumerate(words)), "x")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    want = dict(con.execute("SELECT doc, term FROM v"))
    assert [stem.stem(w) for w in words] == [want[k] for k in range(len(words))]
    arrays = spark.createDataFrame([(["running", None, ""],), ([],), (None,)], "w array<string>").select(stem.stems(F.col("w")).alias("s"))
    assert [r.s for r in arrays.collect()] == [["run", None, ""], [], None]


def test_stemmed_search_equals_sqlite(spark):
    rnd = random.Random(5)
    bag = "storm storms storming warned warning warnings report reported reporter river rivers flooding flooded city cities".split()
    rows = [(k, " ".join(rnd.choices(bag, k=4)), " ".join(rnd.choices(bag + ["calm", "quiet", "plain"] * 9, k=rnd.randrange(1, 30)))) for k in range(80)]
    con = _fts5(rows, "title, text")
    postings = search.index(spark.createDataFrame(rows, "article_id long, title string, text string").withColumn("published", F.lit("2024-01-01")), stemmed=True)
    docs = search.catalogue(postings)
    for query, match in (("cities", '"cities"'), ("flooded reporting", '"flooded" OR "reporting"'), ("storms-warning", '"storms-warning"')):
        want = dict(con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (match,)))
        got = {r.article_id: r.score for r in search.scores(postings, docs.select("article_id", "length"), query, True).collect()}
        assert want and got == pytest.approx(want, abs=2e-6)


def test_phrases(spark):
    titles = spark.createDataFrame([("Ocean Storm Warning!",), ("ocean storm",), ("The www",), (None,)], "title string")
    assert [(r.gram, r.n) for r in keywords.phrases(titles, 9).collect()] == [("ocean storm", 2), ("ocean storm warning", 1), ("storm warning", 1)]
    assert [r.gram for r in keywords.phrases(titles.limit(0), 9).collect()] == list(keywords.FALLBACK)


def test_links_of_copies_make_the_same_components(spark):
    rnd = random.Random(3)
    rows = [(a, f"r{x}") for a in range(200) for x in (rnd.sample(range(60), 3) if a % 4 else [0, 1, 2])]
    role = spark.createDataFrame(rows, "article_id long, norm string")
    from newsloom.operators.graph import connected_components

    part = lambda edges: {r.node: r.component for r in connected_components(edges).collect()}
    assert part(lineage.linked(role, 400)) == part(lineage.shared_pairs(role, 400))


def test_whole_engine(spark, sf, tmp_path):
    base = lineage.articles(spark, sf).select("source_id").distinct().withColumn("trust", F.lit(0.5))
    news = News(spark, sf, base, 1704326400, str(tmp_path / "store"))
    done = news.run(summarize=lambda rows: rows.select("article_id", F.substring("text", 1, 20).alias("summary")))
    n = done.lineage.count()
    assert n == lineage.narratives(news.member).count() and done.stale.count() == 0 and done.brief.count() == 8 and done.trust.count() == base.count()
    again = news.run(most_stories=n - 3)
    assert again.stale.count() == 3 and again.lineage.count() == n - 3
    assert not {r.article_id for r in again.pending.collect()} & {r.article_id for r in done.pending.collect() if r.article_id < 10}
    assert news.find_narratives(["no such words"]).count() == 0 and news.search("license").total >= 0
    near = news.query("q", lambda _: [1.0] * 64, k=5, min_trust=0.0)
    assert 1 <= near.count() <= 5  # vectors without an article are left out
    report = news.evaluate(news.roles.limit(0), str(tmp_path / "report")).collect()
    assert {r.recall for r in report} == {0.0} and spark.read.json(str(tmp_path / "report")).count() == len(report)
    news.export_graph(str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph/edges")).where("kind = 'source'").count() == news.articles.count()
    story = news.member.first().cluster_id
    assert news.story_sources(story, base).count() >= 1


def _similar(rows, together=(), vectors=None):
    """Every pair by plain loops."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    seen, out = {(a, b): n for a, b, n in together}, set()
    for i, role, x in rows:
        for j, other, y in rows:
            if i < j and role == other and x and y:
                p, q = set(x.split(" ")), set(y.split(" "))
                shared = len(p & q) / max(len(p), len(q))
                near = round(1 - distance(x, y) / max(len(x), len(y)), 6) >= 0.85
                if round(shared, 6) >= 0.5 or near or (seen.get((i, j), 0) >= 3 and shared > 0):
                    out.add((i, j))
    return out


def test_propose_loses_no_pair(spark):
    rng = random.Random(8)
    names = ["johnathan", "jahnathan", "johnathon", "a b c d", "a x y z", "", "a", "ab", "abc", "aaaaaaa", "aaaaaaab", "baaaaaaa", "aaaa aaaa aaaa", "aaaa aaaa aaab", "same words here", "here same words"]
    for _ in range(60):
        base = "".join(rng.choices("abcd ", k=rng.randint(3, 60))).strip() or "x"
        names.append(base)
        for _ in range(3):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) * 15 // 100) + 1)):
                at = rng.randrange(len(text) + 1)
                rng.choice([lambda: text.insert(at, rng.choice("abcdz")), lambda: text and text.pop(at % len(text)), lambda: text and text.__setitem__(at % len(text), "z")])()
            names.append("".join(text))
    rows = [(i, "who" if i % 5 else "what", " ".join(n.split())) for i, n in enumerate(names)]
    together = [(3, 4, 5), (0, 3, 9), (1, 2, 2), (4, 14, 3)]
    rows[0:5] = [(i, "who", n) for i, n in enumerate(names[:5])]
    df = spark.createDataFrame(rows, "id long, role string, norm string")
    seen = spark.createDataFrame(together, "a long, b long, n long")
    got = {(r.a, r.b) for r in identity.propose(df, seen).collect()}
    want = _similar(rows, together)
    assert got == want and {(0, 1), (3, 4)} <= want and len(want) > 150


def test_propose_by_vectors(spark):
    rows = spark.createDataFrame([(1, "who", "red"), (2, "who", "blue sea"), (3, "who", "green"), (4, "what", "grey")], "id long, role string, norm string")
    x = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.95, 0.2]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, x array<double>")
    got = identity.propose(rows, vectors=x).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)] and got[0].cosine > 0.9


def test_readers_see_one_run(spark, sf, tmp_path):
    base = spark.createDataFrame([("src1", 0.5)], "source_id string, trust double")
    news = News(spark, sf, base, 1704326400, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        news.published("brief")
    news.run()
    first = {n: _rows(news.published(n), *news.published(n).columns) for n in ("narratives", "links", "trust", "brief")}
    assert len(first["narratives"]) > 10 and len(first["brief"]) == 8
    broken = News(spark, sf, base, 1704326400, str(tmp_path / "store"))
    broken.update_trust = lambda: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.run(most_stories=3)
    assert VersionedTable(spark, str(tmp_path / "store/narratives")).read().count() == 3
    assert {n: _rows(news.published(n), *news.published(n).columns) for n in first} == first
    news.run(most_stories=5)
    assert news.published("narratives").count() == 5 and news.published("brief").count() == 5
    with pytest.raises(FileNotFoundError):
        news.published("summaries")


def test_budgets(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)] + [(99, None), (100, "t")], "article_id long, source_id string")
    take = lambda most: [tuple(r) for r in budget.within_budget(rows, most).orderBy("source_id", "article_id").collect()]
    assert take(8) == [(0, "s0"), (3, "s0"), (1, "s1"), (4, "s1"), (2, "s2"), (5, "s2"), (100, "t")]
    assert take(2) == [(0, "s0"), (1, "s1")] and take(0) == [] and len(take(1000)) == 31
    assert budget.within_budget(rows.limit(0), 5).count() == 0
