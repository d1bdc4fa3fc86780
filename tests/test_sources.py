import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordering import dense_index, lookup
from tidemark.operators.explore import article_filter, exact_median
from tidemark.operators.trends import daily_counts, emerging_topics
from tidemark.sources import articles as art
from tidemark.sources import feeds as fd
from tidemark.sources import store as st
from tidemark.sources.feed_files import ItemCutter
from tidemark.streaming import news as sn


def test_ingest_golden(spark):
    rows = [("A", "s1", "2026-01-02"), ("A", "s1", "2026-01-05"), ("  ", "s2", "2026-01-09"), ("B", None, "bad")]
    out = art.normalize_articles(spark.createDataFrame(rows, " Headline string, Publisher string, date string"))
    got = [(r["article_id"], r["title"], r["source"], r["published"]) for r in out.orderBy("article_id").collect()]
    assert got == [(0, "A", "s1", dt.datetime(2026, 1, 2)), (1, "B", "Unknown", dt.datetime(2026, 1, 9))]
    assert out.columns == ["article_id", *art.COLUMNS]


def test_missing_title(spark):
    with pytest.raises(ValueError, match="title"):
        art.canonical_columns(spark.createDataFrame([("x",)], "body string"))


def test_dates(spark):
    want = {
        "Mon, 02 Jan 2026 10:00:00 GMT": dt.datetime(2026, 1, 2, 10),
        "Mon, 2 Jan 2026 10:00:00 +0530": dt.datetime(2026, 1, 2, 4, 30),
        "2026-01-02T10:00:00-08:00": dt.datetime(2026, 1, 2, 18),
        "2026-01-02 10:00": dt.datetime(2026, 1, 2, 10),
        "2026-01-02": dt.datetime(2026, 1, 2),
        "01/02/2026": dt.datetime(2026, 1, 2),
        "12:30:00": None,
        "soon": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").coalesce(1)
    assert [r[0] for r in df.select(art.parse_published("t")).collect()] == list(want.values())


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,content,date\n"He said ""no""\nagain",text,2026-01-02\nB,c,\n')
    (tmp_path / "a.json").write_text('[{"title": "T1", "date": "2026-01-02"}, {"title": "T2", "link": "u"}]')
    (tmp_path / "a.jsonl").write_text('{"headline": "L1"}\n{"headline": "L2", "short_description": "d"}\n')
    titles = [r["title"] for r in art.read_articles(spark, str(tmp_path / "a.csv")).orderBy("article_id").collect()]
    assert titles == ['He said "no"\nagain', "B"]
    assert art.read_articles(spark, str(tmp_path / "a.json")).count() == 2
    lines = art.read_articles(spark, str(tmp_path / "a.jsonl")).orderBy("article_id").collect()
    assert [(r["title"], r["description"]) for r in lines] == [("L1", ""), ("L2", "d")]


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert st.count_articles(spark, path) == 0 and st.load_articles(spark, path).columns == art.COLUMNS
    schema = "title string, description string, source string, url string, published timestamp_ntz, author string, category string"

    def batch(urls):
        return spark.createDataFrame([("t", "", "s", u, None, "", "") for u in urls], schema)

    assert st.save_articles(batch(["u1"]), path) == 1
    assert st.save_articles(batch(["u1", "u2", "u2", None, ""]), path) == 3
    assert sorted(r["id"] for r in st.load_store(spark, path).collect()) == [1, 2, 3, 4]


def test_feed_file(spark, tmp_path):
    item = "<item><title>{0}</title><link>u{0}</link><pubDate>Mon, 02 Jan 2026 10:00:00 GMT</pubDate><category>a</category><category>b</category></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(item.format(i) for i in range(5)) + "</channel></rss>")
    parsed = fd.read_feed(spark, "F", str(tmp_path / "f.xml"))
    rows = fd.collect_feeds([parsed], limit=3).orderBy("pos").collect()
    assert [(r["title"], r["source"], r["category"]) for r in rows] == [(str(i), "F", "a") for i in range(3)]
    feeds = spark.createDataFrame([("F",), ("G",)], "feed string")
    status = {r["feed"]: r["status"] for r in fd.feed_status(feeds, parsed).collect()}
    assert status == {"F": "5 articles", "G": "no entries (feed empty or unreachable)"}


def test_feed_fields(spark, tmp_path):
    rss = (
        '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>R</title><link>https://r</link>'
        "<dc:creator>Ann</dc:creator><category>a</category></item></channel></rss>"
    )
    atom = (
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A &amp; B</title>'
        '<link rel="self" href="https://s"/><link href="https://a"/><author><name>Joe</name></author>'
        '<category term="t1"/><category term="t2"/><updated>2026-01-02T10:00:00Z</updated></entry></feed>'
    )
    (tmp_path / "r.xml").write_text(rss)
    (tmp_path / "a.xml").write_text(atom)
    both = [fd.read_feed(spark, "R", str(tmp_path / "r.xml")), fd.read_feed(spark, "A", str(tmp_path / "a.xml"), "entry")]
    got = {r["source"]: (r["title"], r["url"], r["author"], r["category"]) for r in fd.collect_feeds(both).collect()}
    assert got == {"R": ("R", "https://r", "Ann", "a"), "A": ("A & B", "https://a", "Joe", "t1")}


def items_of(data, size):
    """What the cutter gives for ``data`` in chunks of ``size`` bytes."""
    cutter, out = ItemCutter(), []
    for chunk in [*(data[i : i + size] for i in range(0, len(data), size)), b""]:
        out += cutter.feed(chunk)
        if cutter.error:
            break
    return out, cutter.error


@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_items_are_cut_at_any_chunk(size):
    inner = ["<item a='x>y'><title>é &amp; <![CDATA[</item> <item>]]></title></item>", "<item><item>in</item></item>", "<item/>", "<item>z/></item >", "<item/>"]
    text = "<rss><!-- <item> --><channel><title>t</title>" + "".join(inner) + "</channel></rss>"
    assert items_of(text.encode(), size) == (inner, None)
    for encoding in ("iso-8859-1", "windows-1252", "utf-8"):
        head = f'<?xml version="1.0" encoding="{encoding}"?>'
        assert items_of((head + text).encode(encoding), size) == (inner, None)
    if size > 1:
        assert items_of(text.encode("utf-16"), size) == (inner, None)
    cut, error = items_of(text.encode()[:-30], size)
    assert cut == inner[:-2] and error
    assert items_of("<feed><entry>1</entry><entry>2</b></feed>".encode(), size)[0] == ["<entry>1</entry>"]


def landing(root, feed, name, items, atom=False):
    item = (
        '<entry><title>{0} &amp; é</title><link href="u{0}"/><updated>2026-01-02T10:00:00Z</updated><author><name>Joe</name></author></entry>'
        if atom
        else "<item><title><![CDATA[{0} & é]]></title><link>u{0}</link><pubDate>Fri, 02 Jan 2026 10:00:00 GMT</pubDate><dc:creator>Ann</dc:creator></item>"
    )
    body = "".join(item.format(i) for i in items)
    text = f"<feed>{body}</feed>" if atom else f"<rss xmlns:dc='http://purl.org/dc/elements/1.1/'><channel>{body}</channel></rss>"
    (root / feed).mkdir(parents=True, exist_ok=True)
    (root / feed / name).write_text(text)


def test_feed_stream(spark, tmp_path):
    """Files that land in three steps, with a lost commit, a broken and an empty file: the same articles as one batch read of each file."""
    root = tmp_path / "in"
    articles, fetches, state = (str(tmp_path / n) for n in ("articles", "fetches", "state"))

    def take():
        sn.run_once(sn.feed_items(spark, str(root), 4), sn.keep_feeds(articles, fetches), state)

    landing(root, "R", "01.xml", range(6))
    landing(root, "A", "01.xml", range(10, 13), atom=True)
    (root / "R" / "_part").write_text("not read")
    take()
    landing(root, "R", "02.xml", [20])
    (root / "E").mkdir()
    (root / "E" / "01.xml").write_text("")
    take()
    take()  # nothing new
    landing(root, "A", "02.xml", range(30, 40), atom=True)
    (root / "B").mkdir()
    (root / "B" / "01.xml").write_text("<rss><channel><item><title>b</ti")
    take()
    got = spark.read.parquet(articles)
    assert [r["n"] for r in got.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [7, 1, 4]
    for f in (*(tmp_path / "state" / "commits").glob("2"), *(tmp_path / "state" / "commits").glob(".2*")):
        f.unlink()
    take()

    want = []
    for feed, name, tag in (("R", "01.xml", "item"), ("R", "02.xml", "item"), ("A", "01.xml", "entry"), ("A", "02.xml", "entry")):
        one = fd.collect_feeds([fd.read_feed(spark, feed, str(root / feed / name), tag)], limit=4)
        want += [tuple(r) for r in one.drop("pos").collect()]
    got = spark.read.parquet(articles)
    assert sorted(tuple(r) for r in got.drop("file", "pos", "batch").collect()) == sorted(want)
    assert len(want) == 12 and {r["author"] for r in got.collect()} == {"Ann", "Joe"}
    feeds = spark.createDataFrame([(n,) for n in "RAEBX"], "feed string")
    status = {r["feed"]: r["status"] for r in fd.newest_status(feeds, spark.read.parquet(fetches)).collect()}
    none = "no entries (feed empty or unreachable)"
    assert status == {"R": "1 articles", "A": "4 articles", "E": none, "B": "error: malformed feed item", "X": none}

    batch = fd.landed_items(spark.read.format("landed_feeds").option("limit", 4).load(str(root)))
    assert sorted(fd.landed_articles(batch).collect()) == sorted(got.drop("batch").collect())

    store = str(tmp_path / "store")
    items = sn.feed_items(spark, str(root), 4)
    sn.store_new(fd.landed_articles(items), store, str(tmp_path / "state2"))
    assert st.count_articles(spark, store) == 12


def test_missing_words(spark, tmp_path):
    (tmp_path / "m.csv").write_text("title,source,description\nT,NA,None\nN/A,s,d\nU,none,<NA>\n")
    rows = art.read_csv(spark, str(tmp_path / "m.csv")).orderBy("article_id").collect()
    assert [(r["title"], r["source"], r["description"]) for r in rows] == [("T", "Unknown", ""), ("U", "none", "")]


def test_repeated_save(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "title string, description string, source string, url string, published timestamp_ntz, author string, category string"
    rows = [(f"t{i}", "", "s", u, None, "", "") for i, u in enumerate(["u1", "", None, "u1"])]
    batch = spark.createDataFrame(rows, schema).coalesce(1)
    assert st.save_articles(batch.limit(1), path, name="q-0") == 1
    for _ in range(2):
        assert st.save_articles(batch, path, name="q-1") == 2
        assert sorted(r["id"] for r in st.load_store(spark, path).collect()) == [1, 2, 3]


def test_store_by_day(spark, tmp_path):
    """A date filter opens the folders of its days only, late articles included; a save that failed half way costs ids at most."""
    path = str(tmp_path / "store")
    schema = "title string, description string, source string, url string, published timestamp_ntz, author string, category string"

    def batch(days, tag):
        rows = [(f"t{tag}{i}", "", "s", f"u{tag}{i}", d and dt.datetime(2026, 1, d, 23, 59, 59), "", "") for i, d in enumerate(days)]
        return spark.createDataFrame(rows, schema)

    assert st.save_articles(batch([1, 2, 2, 3, None], "a"), path) == 5
    assert st.save_articles(batch([2, 9], "b"), path) == 2
    assert st.save_articles(batch([2, 9], "b"), path) == 0
    table = st.load_days(spark, path)
    got = article_filter(table, days=(dt.date(2026, 1, 2), dt.date(2026, 1, 3)), day_col="day")
    assert sorted(r["title"] for r in got.collect()) == ["ta1", "ta2", "ta3", "tb0"]
    scan = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in scan and "2026-01-02" in scan and "2026-01-03" in scan
    assert len(list((tmp_path / "store").glob("batch=*/day=2026-01-02"))) == 2
    assert [r["title"] for r in table.filter("day is null").collect()] == ["ta4"]
    assert st.load_store(spark, path).columns == ["id", *art.COLUMNS, "fetched_at"]

    spark.range(1).selectExpr("9L as last").write.parquet(f"{path}-ids/batch=failed")  # noted, never written
    assert st.save_articles(batch([4], "c"), path, name="x") == 1
    assert st.save_articles(batch([4, 5], "c"), path, name="x") == 2
    assert sorted(r["id"] for r in st.load_store(spark, path).collect()) == [1, 2, 3, 4, 5, 6, 7, 10, 11]


def test_stream_restart(spark, tmp_path):
    """New files are taken once; a batch whose commit was lost is taken again and replaces itself."""
    landed, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    schema = "headline string, link string, date string"
    for i, url in enumerate(["u1", ""]):
        spark.createDataFrame([(f"T{i}", url, "2026-01-02")], schema).coalesce(1).write.mode("append").parquet(landed)
        sn.store_new(sn.landed(spark, landed, schema), store, state)
    assert st.count_articles(spark, store) == 2
    for f in (tmp_path / "state" / "commits").glob("*1*"):
        f.unlink()
    for f in (tmp_path / "state" / "commits").glob(".1*"):
        f.unlink()
    sn.store_new(sn.landed(spark, landed, schema), store, state)
    assert sorted(r["id"] for r in st.load_store(spark, store).collect()) == [1, 2]


def test_trend_cells(spark, tmp_path):
    """The trend table of all batches equals that of the whole table, and counts alone are kept."""
    landed, cells, trends, state = (str(tmp_path / n) for n in ("in", "cells", "trends", "state"))
    schema = "article_id long, published timestamp_ntz, source string, cluster int"
    rows = [(i, dt.datetime(2026, 1, 1 + i * i % 9), f"s{i % 4}", i % 3 - 1) for i in range(60)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landed)
        sn.refresh_trends(sn.landed(spark, landed, schema), cells, trends, state)
    newest = spark.read.parquet(f"{trends}/batch=1")
    want = emerging_topics(spark.createDataFrame(rows, schema))
    assert sorted(newest.collect()) == sorted(want.collect())
    assert set(spark.read.parquet(cells).columns) == {"topic_id", "day", "source", "n", "batch"}


def test_late_articles_count(spark, tmp_path):
    """Files out of order, a restart and a lost commit: the stream's table equals the batch operator's."""
    landed, totals, state = (str(tmp_path / n) for n in ("in", "totals", "state"))
    schema = "article_id long, published timestamp_ntz, source string, cluster int"
    rows = [(i, dt.datetime(2026, 1, 1) + dt.timedelta(days=(90 - i) * 7 % 40), "s", i % 4 - 1) for i in range(90)]
    for part in (rows[50:], rows[:20], rows[20:50]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landed)
        sn.count_topics(sn.landed(spark, landed, schema), totals, state)
    for f in (*(tmp_path / "state" / "commits").glob("2"), *(tmp_path / "state" / "commits").glob(".2*")):
        f.unlink()
    sn.count_topics(sn.landed(spark, landed, schema), totals, state)
    want = daily_counts(spark.createDataFrame(rows, schema))
    assert sorted(sn.current_counts(spark, totals).collect()) == sorted(want.collect())
    last = spark.read.parquet(f"{totals}/batch=2").count()
    assert last < want.filter("n > 0").count()  # only what the batch has touched


def test_cells_are_merged_like_a_counter(spark, tmp_path):
    """After 50 batches, some written twice, all cells are there and few folders are read."""
    cells = str(tmp_path / "cells")
    schema = "topic_id int, day date, source string, n long"
    total = {}
    for b in range(50):
        rows = [(b % 3, dt.date(2026, 1, 1 + b % 9), f"s{b % 2}", b + 1), (7, dt.date(2026, 2, 1), "s", 1)]
        for t, day, source, n in rows:
            total[t, day, source] = total.get((t, day, source), 0) + n
        for _ in range(2 if b in (3, 15, 16, 31) else 1):
            out = sn.keep_cells(spark.createDataFrame(rows, schema).coalesce(1), cells, b)
        if b in (0, 3, 16, 49):
            assert {(r["topic_id"], r["day"], r["source"]): r["n"] for r in out.collect()} == total
        assert len(sn.standing(cells, b)) <= (b + 1).bit_length()
    assert len(sn.standing(cells, 49)) == 3


def test_feed_list():
    assert len(fd.feed_list()) == 9
    assert fd.feed_list({"A": "u"}, " My Feed | https://x|y ") == {"A": "u", "My Feed": "https://x|y"}


def test_dense_index_and_lookup(spark):
    values = [5, 1 << 21, (1 << 21) + 3, 1 << 45, -7, 900]
    got = dense_index(spark.createDataFrame([(v,) for v in values], "v long"), "v", "i")
    assert {r["v"]: r["i"] for r in got.collect()} == {v: i for i, v in enumerate(sorted(values))}
    big = spark.createDataFrame([(1,)] * 50 + [(2,), (3,)], "k long")
    small = spark.createDataFrame([(1, 50, "a"), (2, 1, "b")], "k long, n long, x string")
    out = lookup(big, small, ["k"], "n", 10)
    assert {(r["k"], r["x"]): r["count"] for r in out.groupBy("k", "x").count().collect()} == {
        (1, "a"): 50, (2, "b"): 1, (3, None): 1,
    }


def test_exact_median(spark):
    groups = {"a": [1.0], "b": [1.0, 4.0], "c": [2.0] * 9 + [1.0, 7.0], "d": [float(i * i % 101) for i in range(1000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    import statistics

    got = {r["g"]: r["v"] for r in exact_median(df, "g", "v").collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}
