"""Chat formatting that is proved by parsing it again.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "<|" role "|>" LF content "<|end|>" LF

The parser is deterministic: a role ends at the first ``|>`` and LF after it, a
content at the first ``<|end|>`` and LF; then in both one backslash goes from
every run of backslashes between ``<`` and ``|`` or between ``|`` and ``>``.
Escaping adds one to each such run, also to an empty one, so it is undone
exactly and leaves no marker standing.

A conversation is rendered as it is, parsed, and compared to its source; the
first turn that differs is escaped and parsed again, and so on to the end.  The
parser never looks behind a turn that came back, so each is parsed twice at
most, however many need an escape; at last the whole text is parsed once more
and must give back the source.  Nearly all turns need no escape and stay byte
for byte.

Defined results: turns are in order of (turn, role, text), nulls first, so ties
and repeated rows have a fixed order, and repeated rows are repeated turns.  A
null role or text counts as an empty one.  A row with a null conv_id is a
conversation of its own.  Turns and conversations of any length are read whole.
An empty table gives no conversations.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

_RUN = re.compile(r"<(\\*)\||\|(\\*)>")
_ESCAPED = re.compile(r"<\\(\\*)\||\|\\(\\*)>")

Turn = tuple[str, str]


def escape(text: str) -> str:
    out, at = [], 0
    while m := _RUN.search(text, at):
        # the last character may begin the next run
        out.append(text[at : m.start() + 1] + "\\")
        at = m.start() + 1
        out.append(text[at : m.end() - 1])
        at = m.end() - 1
    return "".join([*out, text[at:]])


def unescape(text: str) -> str:
    out, at = [], 0
    while m := _ESCAPED.search(text, at):
        out.append(text[at : m.start() + 1] + text[m.start() + 2 : m.end() - 1])
        at = m.end() - 1
    return "".join([*out, text[at:]])


def render(turns: list[Turn], escaped: set[int] = frozenset()) -> str:
    return "".join("<|%s|>\n%s<|end|>\n" % ((escape(r), escape(t)) if k in escaped else (r, t)) for k, (r, t) in enumerate(turns))


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered conversation; None if it isn't one."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("<|", at):
            return None
        role = text.find("|>\n", at + 2)
        end = text.find("<|end|>\n", role + 3) if role >= 0 else -1
        if end < 0:
            return None
        turns.append((unescape(text[at + 2 : role]), unescape(text[role + 3 : end])))
        at = end + 8
    return turns


def comes_back(text: str, turn: Turn) -> bool:
    """Whether the parser reads ``text``, from its beginning to its end, as this turn."""
    role = text.find("|>\n", 2)
    end = text.find("<|end|>\n", role + 3)
    return end + 8 == len(text) and (unescape(text[2:role]), unescape(text[role + 3 : end])) == turn


def format_turns(turns: list[Turn]) -> tuple[str, int]:
    """The rendered conversation and how many turns had to be escaped."""
    parts, escaped = [], 0
    for turn in turns:
        text = render([turn])
        if not comes_back(text, turn):
            text, escaped = render([turn], {0}), escaped + 1
        parts.append(text)
    whole = "".join(parts)
    if parse(whole) != turns:
        raise AssertionError("a conversation doesn't come back")
    return whole, escaped


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, many = [], [], []
        for turns in batch.column(1).to_pylist():
            own = [(t["role"] or "", t["text"] or "") for t in turns]
            text, n = format_turns(own)
            texts.append(text)
            counts.append(n)
            many.append(len(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(many, pa.int64()), pa.array(counts, pa.int64())], names=["conv_id", "text", "n_turns", "n_escaped"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, text, n_turns, n_escaped) of every conversation."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    ordered = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = turns.filter("conv_id IS NULL").select("conv_id", F.array("t").alias("turns"))
    return ordered.unionByName(alone).mapInArrow(_run, "conv_id long, text string, n_turns long, n_escaped long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(K.table(spark, sf_dir, "conversations"))


# A turn needs an escape if and only if it holds an escaped run or the mark that would end it early;
# a role, also where a mark stands across its end.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
),
judged AS (
  SELECT *, regexp_matches(t, '<\\+\||\|\\+>') OR contains(t, '<|end|>' || chr(10)) OR regexp_matches(r, '<\\+\||\|\\+>') OR contains(r, '|>' || chr(10)) AS bad FROM turns
),
shown AS (
  SELECT *, '<|' || CASE WHEN bad THEN regexp_replace(regexp_replace(r, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') ELSE r END || '|>' || chr(10)
    || CASE WHEN bad THEN regexp_replace(regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') ELSE t END || '<|end|>' || chr(10) AS line FROM judged
)
SELECT conv_id, string_agg(line, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text, count(*) AS n_turns, count(*) FILTER (bad) AS n_escaped
FROM shown GROUP BY conv_id, alone
"""
