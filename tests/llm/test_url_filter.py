"""Rules against a plain reading, and held-out accuracy of the trained method."""

import random

from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import filter_urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


URLS = [
    None, "", "x.net/a", "http://a.net", "http://a.net/", "HTTP://A.NET/en/", "http://example.net/en/x?y", "http://www.example.net/en", "http://example.com/de/1#t", "https://b.example.com/DE/1",
    "ftp://org/fr/", "http://x.org/fr/1", "http://x.orgs/fr/", "http://ÄÖ.net/ü", "http://xexample.com/de/", "://net/", "a://b://c.net/", "http://?q", "http://net?x=/", "http://a..net/ ",
]


def test_rules(spark):
    rows = [(i, u, "old") for i, u in enumerate(URLS)] + [(3, URLS[3], "old"), (None, "http://z.net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(3)
    got = filter_urls(df, spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path) == plain(r.url), r
        want = ruled(r.host, r.path)
        assert r.rule == (want[0] if want else None) and r.verdict in ("block", "allow")
        assert want is None or r.verdict == want[1]


def test_learns_from_labelled_urls(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeghilmnorst") for _ in range(n))

    def url(bad):
        if bad:
            return f"http://{word(4)}-{rng.randrange(10**6)}-{word(5)}.{word(3)}.com/{word(20)}?{'&'.join(word(2) + '=' + str(rng.randrange(999)) for _ in range(5))}"
        return f"https://www.{word(8)}.com/{word(4)}/{word(5)}.html"

    rows = [(i, url(i % 2), i % 2) for i in range(600)]
    labelled = spark.createDataFrame([(u, y) for _, u, y in rows[:400]] + [(None, None), ("x", 7)], "url string, label int")
    held = spark.createDataFrame(rows[400:], "page_id long, url string, label int")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = filter_urls(held, none, labelled=labelled).collect()
    assert sum((r.verdict == "block") == bool(r.label) for r in got) >= 190


def test_empty_tables_and_one_class(spark):
    rules = spark.createDataFrame(URL_RULES[:1], "host string, path string, verdict string")
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []
    got = filter_urls(spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.de/")], "page_id long, url string"), rules).collect()
    assert sorted((r.page_id, r.verdict, r.score) for r in got) == [(1, "block", 0.0), (2, "allow", 0.0)]


def test_clashing_columns_and_native_plan(spark):
    own = ["_host", "_label", "_rule", "_order", "_url", "c0", "c1", "a.b", "parent", "verdict"]
    rows = [(i, f"http://a{i % 3}.{tail}", *own) for i, tail in enumerate(["net/x", "example.net/en/y", "com/z", "net/", "org/fr/"] * 4)]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = filter_urls(spark.createDataFrame(rows, ["page_id", "url", *own]), rules)
    got = out.collect()
    assert len(got) == 20 and all(r[c] == c for r in got for c in own[:-1])
    assert all((r.host, r.path) == plain(r.url) and r.verdict in ("block", "allow") for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
