"""String kernel against its definition, held-out accuracy, gapped and inserted insults."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm import toxicity as tx


def plain_kernel(s, t):
    def weights(w):
        w = f"^{w}$"
        out = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < tx.SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + tx.DECAY ** (k - i + 1)
        norm = sum(tx.DECAY ** (2 * (k - i + 1)) for i, j, k in combinations(range(len(w)), 3) if k - i < tx.SPAN) ** 0.5
        return {x: v / norm for x, v in out.items() if "." not in x}

    a, b = weights(s), weights(t)
    return sum(v * b.get(x, 0) for x, v in a.items())


def test_kernel_equals_definition():
    words = ["idiot", "idxiot", "tion", "abcabcabcabcab", "aaa", "worthless", "zyxwvutsrqponmlkjihg", "i.d.i.o.t"]
    column, width = tx._columns(words)
    mapped = tx._mapped(words, column, width)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert np.isclose(mapped[i] @ mapped[j], plain_kernel(a, b), rtol=1e-4)
        table = np.zeros(len(column), np.float32)
        table[column >= 0] = mapped[i]
        assert np.allclose(tx.word_values(words, table, 0.5), mapped @ mapped[i] + 0.5, rtol=1e-4)


def test_words_in():
    words, place, first = tx.words_in(pa.array(["Ab, c i d i o t x1", None, "", "a b", "É.é (q)"]))
    own = [[words[w] for w in place[a:b]] for a, b in zip(first[:-1], first[1:])]
    assert own == [["ab", "c", "i", "d", "i", "o", "t", "x1", "cidiot"], [""], [""], ["a", "b"], ["é.é", "q"]]


@pytest.fixture(scope="module")
def model(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents")
    return tx.train(docs, queries.table(spark, "/root/testdata/sf0.1", "labels").filter(~queries.held_out()))


def test_held_out_accuracy(spark, model):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").filter(queries.held_out())
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels")
    rows = tx.score(docs, model).join(labels, "doc_id").select("toxic", "score", F.rlike(F.lower("text"), F.lit(r"\b(idiot|moron|stupid|worthless|pathetic)\b")).alias("plain")).collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    # about a sixth of the toxic labels are on texts without any insult, so 0.85 is what the texts allow
    assert ((s >= 0.5)[y == 1]).mean() > 0.84 and ((s >= 0.5)[y == 0]).mean() < 0.02
    insulting = np.array([r.plain for r in rows])
    assert insulting.sum() > 40 and (s[insulting] >= 0.5).all()


def test_insults_behind_the_first_window_are_learned():
    rng = np.random.default_rng(3)
    parts = "the and ation ere ing ble hat was here ore thin".split()

    def word():
        return "".join(rng.choice(parts, 2))

    def bag(bad):
        tail = rng.choice(["idiot", "moron"]) if bad else rng.choice(parts)
        return sorted({word() for _ in range(30)} | {"-".join([*(word() for _ in range(5)), tail])})

    y = np.array([1] * 60 + [0] * 120)
    model = tx.fit([bag(k) for k in y], y)
    worst = np.array([tx.word_values(bag(k), model.table, model.bias).max() for k in y])
    assert ((model.chance(worst) >= 0.5) == y).all()


def test_gapped_and_inserted_insults(spark, model):
    clean = "The and attion to thanedble the anea eriner thanea then edinth is thndor"
    insults = ["idiot", "i.d.i.o.t", "i d i o t", "idi-ot", "idxiot", "IDIOT!", "worthless", "w-orthless", "worth.less", "pathetic", "pathxetic", "stupid", "s.t.u.p.i.d"]
    df = spark.createDataFrame([(i, f"{clean} {w} {clean}") for i, w in enumerate(insults)] + [(99, clean)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in tx.score(df, model).collect()}
    assert got[99] < 0.5 and sum(got[i] >= 0.5 for i in range(len(insults))) >= 12


def test_edges(spark, model):
    rows = [(1, None, 5.0, "k"), (2, "", None, None), (3, "x " * 100_000 + "idiot", 1.0, "k"), (3, "a" * 100_000, 1.0, "k"), (None, "idiot", 0.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, c0 string")
    got = tx.score(df, model).collect()
    assert len(got) == 5 and [r.score >= 0.5 for r in sorted(got, key=str) if r.text and "idiot" in r.text] == [True, True]
    assert len({r.score for r in got if not r.text}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert tx.score(df.limit(0), model).collect() == []
    none = tx.train(df, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {r.score for r in tx.score(df, none).collect()} <= {0.0} or max(r.score for r in tx.score(df, none).collect()) < 1e-9
    assert tx.score(df.withColumn("score", F.lit("s")), none).schema["score"].dataType.simpleString() == "double"
