"""Event folding and rendering: goldens, exact round trip, and the SQL twin."""

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.chat import fold_events, format_chats, read_back, render, turn_events

KIND = "conv_id long, seq long, message long, type string, role string, text string"


def fold(spark, rows):
    return sorted(map(tuple, fold_events(spark.createDataFrame(rows, KIND)).collect()), key=str)


def test_deltas_edits_and_regenerations(spark):
    log = [
        (1, 10, 1, "message", "user", "que"), (1, 11, 1, "delta", None, "stion"), (1, 20, 2, "message", "assistant", None), (1, 21, 2, "delta", None, "old "),
        (1, 22, 2, "delta", None, "answer"), (1, 30, 2, "regenerate", None, None), (1, 31, 2, "delta", None, "new"), (1, 40, 3, "message", "user", "more"),
        (2, 1, 1, "message", "user", "a"), (2, 2, 2, "message", "assistant", "b"), (2, 3, 3, "message", "user", "c"), (2, 4, 1, "edit", None, "A"), (2, 5, 1, "delta", None, "!"),
        (2, 6, 4, "message", "assistant", "B"), (2, 7, 9, "unknown", "x", "y"), (None, 1, 1, "delta", None, "d"), (None, 1, None, "message", None, None),
    ]
    want = [(1, 1, "user", "question"), (1, 2, "assistant", "new"), (1, 3, "user", "more"), (2, 1, "user", "A!"), (2, 4, "assistant", "B"), (None, 1, None, "d"), (None, None, None, "")]
    assert fold(spark, log) == sorted(want, key=str)
    assert fold(spark, log[::-1]) == sorted(want, key=str)


TEXTS = ["", "\n", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|", "<\\\\|a<|", "<||>", "é日😀", "\\", "<", "|", "<|n|>", "a" * 20000]


def test_round_trip(spark):
    turns = [(7, i, r, t) for i, (r, t) in enumerate((r, t) for t in TEXTS for r in ("user", "assistant", "a\nb<|n|>", ""))]
    turns += [(8, 0, None, None), (8, 0, "assistant", "q"), (8, 0, "assistant", "q"), (8, None, "user", "first"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in read_back(format_chats(turn_events(df))).collect()}
    assert [(t.role, t.text) for t in got[7].turns] == [(r, t) for _, _, r, t in turns if _ is not None][: len(got[7].turns)]
    assert list(got[7].learned) == TEXTS
    assert [(t.role, t.text) for t in got[8].turns] == [("user", "first"), ("", ""), ("assistant", "q"), ("assistant", "q")] and list(got[8].learned) == ["q", "q"]
    assert list(got[None].learned) == ["n"]
    assert got[7].formatted.count("<|im_start|>") == len(TEXTS) * 4


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], KIND)).collect() == []
    assert render(spark.createDataFrame([], "conv_id long, message long, role string, text string")).collect() == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_twin(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = queries.QUERIES["op8_chat_formatting"](spark, sf_dir)
    assert compare(df.columns, [tuple(r) for r in df.collect()], connect(sf_dir), queries.SQL["op8_chat_formatting"]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.filter(F.col("conv_id") == -1).first().n_turns == 2
