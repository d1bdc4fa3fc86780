import html

from pyspark.sql import functions as F

from tidemark.functions import text as tx


def column(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_stop_words():
    words = tx.default_stop_words()
    assert len(set(words)) == len(words) == 318 + len(set(tx.NEWS_STOP_WORDS) - {"also", "one", "two", "will"})
    assert {"the", "computer", "said"} & set(words) == {"the", "said"}


def test_lemma(spark):
    want = {
        "policies": "policy", "flies": "flie", "series": "sery", "chips": "chip", "news": "news",
        "class": "class", "virus": "virus", "basis": "basis", "ties": "ties", "always": "alway",
    }
    assert column(spark, list(want), tx.simple_lemma) == list(want.values())


def test_heavy_clean(spark):
    texts = ["The AI agents' report: 24 new policies at https://x.y/z", "COVID-19 cafés"]
    assert column(spark, texts, tx.heavy_clean) == ["agent policy", "covid-19 caf"]


def test_markup(spark):
    texts = ["&lt;b&gt;Hi&lt;/b&gt; there", "3 < 4", "", None, "<p>a<b>b</b></p><script>x<y</script><!-- c -->e"]
    assert column(spark, texts, tx.light_clean) == ["Hi there", "3 < 4", "", "", "a b e"]


def test_references(spark):
    texts = ["caf&eacute; &copy2 &notit; &#233; &#x1F600; &#128; &#0; &amp;lt; &bogus; a&b &#xD800; &#99999999999;&"]
    assert column(spark, texts, tx.unescape) == [html.unescape(t) for t in texts]


def test_preprocess(spark):
    df = spark.createDataFrame([("Title", None)], "title string, description string")
    row = tx.preprocess_articles(df).first()
    assert (row["embedding_text"], row["tfidf_text"]) == ("Title.", "title")


def test_search(spark):
    df = spark.createDataFrame([("Big Chip", None), (None, "a.b"), ("x", "axb")], "t string, d string")

    def hits(p, **kw):
        return df.filter(tx.article_search(F.col("t"), F.col("d"), p, **kw)).count()

    assert (hits("CHIP"), hits("a.b"), hits("a.b", literal=True)) == (1, 2, 1)
