"""Chat formatting (operator 2): conversations rendered by a compiled template, with the spans that
a loss is taken on, and read back.

Rows are dealt by conversation and sorted by (turn, role, text) in each partition, then rendered as
a stream: a conversation is never held as a whole. A conversation of more than PIECE code points
becomes several rows (conv_id, piece, text, loss), cut between turns.

Null text or role: empty. Null conv_id: one conversation without an id. Null turns come first; ties
and repeated rows are turns of their own. Very long texts are rendered whole, turn by turn. Empty
table: nothing (but for rows that a query adds). Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .template import CONTROL, Template, unescape

#: Turns are marked with control strings, which escape() keeps out of roles and texts.
TEMPLATE = (
    "{%- for m in messages -%}"
    "<|turn|>{{ m.role | escape }}<|text|>"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{%- else -%}{{ m.text | escape }}{%- endif -%}"
    "<|end|>"
    "{%- endfor -%}"
)

#: Code points after which a conversation continues in another row.
PIECE = 1 << 20
#: Rows in a batch that is passed on, and code points.
ROWS, CHARS = 2000, 1 << 22

PIECES = "conv_id long, piece long, text string, loss array<struct<start:long,end:long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

Row = dict[str, Any]


def conversations(rows: Iterator[Row]) -> Iterator[tuple[Any, Iterator[Row]]]:
    """Neighbouring rows of one conv_id; each group is used up before the next is asked for."""
    head = next(rows, None)
    while head is not None:
        key, following = head["conv_id"], [None]

        def group(first=head, key=key, following=following) -> Iterator[Row]:
            yield first
            for r in rows:
                if r["conv_id"] != key:
                    following[0] = r
                    return
                yield r

        turns = group()
        yield key, turns
        for _ in turns:
            pass
        head = following[0]


def formatted(template: Template, rows: Iterator[Row], piece: int = PIECE) -> Iterator[Row]:
    """Rows of PIECES for rows that are sorted by conversation and turn."""
    for key, turns in conversations(rows):
        text, loss, size, n, mark = [], [], 0, 0, [False]

        def messages(turns=turns, mark=mark) -> Iterator[Row]:
            for r in turns:
                mark[0] = True  # what follows belongs to a further turn
                yield {"role": r["role"] or "", "text": r["text"] or ""}

        for t, masked in template.pieces(messages()):
            if mark[0] and size >= piece:
                yield {"conv_id": key, "piece": n, "text": "".join(text), "loss": loss}
                text, loss, size, n = [], [], 0, n + 1
            mark[0] = False
            text.append(t)
            if masked and t:
                loss.append({"start": size, "end": size + len(t)})
            size += len(t)
        yield {"conv_id": key, "piece": n, "text": "".join(text), "loss": loss}


_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def read_back(pieces: Iterator[Row]) -> Iterator[Row]:
    """Rows of DIGEST, from the formatted pieces alone (of the default template)."""
    for key, parts in conversations(pieces):
        turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for p in parts:
            size += len(p["text"])
            for m in _TURN.finditer(p["text"]):
                n += 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for s in p["loss"]:
                t = unescape(p["text"][s["start"] : s["end"]])
                chars += len(t)
                loss.update(t.encode())
        yield {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size}


def _arrow(schema: pa.Schema, *steps):
    """A function over record batches from functions over iterators of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: Iterator[Row] = chain.from_iterable(s.to_pylist() for b in batches for s in (b.slice(i, ROWS) for i in range(0, b.num_rows, ROWS)))
        for step in steps:
            rows = step(rows)
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r.get("text") or "")
            if len(held) >= ROWS or size >= CHARS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _dealt(conv: DataFrame) -> DataFrame:
    return lean(conv).select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_conversations(conv: DataFrame, template: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """The formatted conversations: conv_id, piece, text, loss (spans of code points of text)."""
    t = Template(template)
    return _dealt(conv).mapInArrow(_arrow(_PIECES, lambda rows: formatted(t, rows, piece)), PIECES)


def chat_digest(conv: DataFrame, piece: int = PIECE) -> DataFrame:
    """Per conversation what its formatted text holds: rendered, then read back from the pieces in
    the same pass."""
    t = Template(TEMPLATE)
    return _dealt(conv).mapInArrow(_arrow(_DIGEST, lambda rows: formatted(t, rows, piece), read_back), DIGEST)


#: The conversation that holds control strings in its texts.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def chat_report(conv: DataFrame) -> DataFrame:
    """chat_digest of all conversations and of conversation -1, two rows of CONTROL_TEXT."""
    own = conv.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    return chat_digest(conv.select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(own))


def _escaped(column: str) -> str:
    for c in ("\\", *CONTROL):
        column = f"replace({column}, '{c}', '{c[0]}\\{c[1:]}')"
    return column


#: The same in SQL.
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, {len("<|turn|><|text|><|end|>")} + length({_escaped("role")}) + length({_escaped("text")}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
