import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entspark.llm import chat_format as C

from .conftest import rows

SCHEMA = "conv_id long, turn long, role string, text string"
pieces = st.lists(st.sampled_from(["<|", "|>", "<|end|>", "\n", "\\", "<", "|", ">", "end", "user", "é", " ", "<|user|>\n", "<\\|end|>\n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(pieces, pieces), max_size=6))
def test_round_trip(turns):
    text, escaped = C.format_turns(turns)
    assert C.parse(text) == turns and escaped <= len(turns)


@given(pieces)
def test_escape_is_undone_and_leaves_no_mark(text):
    assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text) and "|>" not in C.escape(text)


def test_plain_turns_stay_as_they_are():
    assert C.format_turns([("user", "a <| b"), ("assistant", "ok")]) == ("<|user|>\na <| b<|end|>\n<|assistant|>\nok<|end|>\n", 0)


def test_many_escapes_take_linear_time():
    import time

    turns = [("user", f"{k}<|end|>\nmore") for k in range(20_000)]
    began = time.perf_counter()
    text, escaped = C.format_turns(turns)
    assert escaped == 20_000 and C.parse(text) == turns and time.perf_counter() - began < 10


def test_text_that_is_no_conversation():
    assert C.parse("hello") is None and C.parse("<|user|>\nno end") is None and C.parse("") == []


def test_nulls_ties_repeats_and_clashes(spark):
    data = [(1, 1, "user", "b"), (1, 0, "system", None), (1, 1, "assistant", "a"), (1, None, None, "x<|end|>\ny"), (2, 0, "user", ""), (2, 0, "user", ""), (None, 1, "user", "z"), (3, 0, "user", "w" * 300_000)]
    frame = spark.createDataFrame(data, SCHEMA)
    out = {r.conv_id: r for r in C.format_chats(frame).collect()}
    assert C.parse(out[1].text) == [("", "x<|end|>\ny"), ("system", ""), ("assistant", "a"), ("user", "b")] and out[1].n_escaped == 1
    assert out[2].n_turns == 2 and out[None].n_turns == 1 and len(out[3].text) > 300_000
    lone = spark.createDataFrame([(None, 1, "user", f"t{k}") for k in range(5)] * 2, SCHEMA)
    assert [r[2] for r in rows(C.format_chats(lone))] == [1] * 10
    more = frame.selectExpr("*", "1 AS t", "2 AS turns", "3 AS n_turns", "4 AS n_escaped")
    assert rows(C.format_chats(more)) == rows(C.format_chats(frame))


def test_empty(spark):
    assert rows(C.format_chats(spark.createDataFrame([], SCHEMA))) == []


@pytest.mark.parametrize("data", [[(1, 0, "u|>\nx", "a"), (1, 1, "u", "b\\"), (1, 2, "u", "<\\|"), (1, 3, "u", "|\\\\> <|end|>\n")], [(5, 0, "a|>", "|>"), (5, 1, "<|", "<|end|>"), (None, 0, "user", "a"), (None, 0, "user", "a")]])
def test_like_the_sql(spark, data):
    import duckdb

    frame = spark.createDataFrame(data, SCHEMA)
    c = duckdb.connect()
    c.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", data)
    assert rows(C.format_chats(frame)) == sorted(c.sql(C.ORACLE).fetchall(), key=repr)
