"""Operator 2: chat formatting with a template that is a black box.

The template is any function from a list of messages to a string. It is called on each prefix of a conversation's turns;
each output is compared with the one before. Where the earlier output is a prefix of the later one, what was added is the turn's
span. Otherwise the template has rewritten history: the turn is flagged, and its span runs from the first
character that differs to the end. Offsets are in the output of that turn's prefix; for a template that only appends
they are offsets in the final text as well. closing is what a template adds at the end and takes back at
the next turn (such as a generation prompt): it is cut off before comparing.

Results: turns are ordered by turn number (null first), then role, then text, so that ties and repeated rows come in a
fixed order, each a turn of its own. A null role is 'user' and a null text ''. Rows with a null conversation id
are one conversation. An empty table gives an empty table; extra columns don't come through (a row is a turn of the output).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES

Message = dict[str, str]
Template = Callable[[list[Message]], str]


def marked_turns(messages: list[Message]) -> str:
    """Turns between start and end marks; only appends."""
    return "".join(f"<|im_start|>{m['role']}\n{m['text']}<|im_end|>\n" for m in messages)


def folded_system(messages: list[Message]) -> str:
    """System texts go inside the first user turn: a later system turn rewrites it."""
    system = "\n".join(m["text"] for m in messages if m["role"] == "system")
    out, first = [], True
    for m in messages:
        if m["role"] == "system":
            continue
        text = f"<<SYS>>\n{system}\n<</SYS>>\n\n{m['text']}" if first and system else m["text"]
        first = False
        out.append(f"[INST] {text} [/INST]" if m["role"] == "user" else f" {text} </s>")
    return "".join(out)


def last_answer_whole(messages: list[Message]) -> str:
    """Keeps the last assistant turn whole and cuts earlier ones to their last paragraph, as templates do that drop reasoning."""
    last = max((k for k, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    return "".join(f"<|{m['role']}|>\n{m['text'] if m['role'] != 'assistant' or k == last else m['text'].rpartition(chr(10))[2]}\n" for k, m in enumerate(messages))


TEMPLATES: tuple[Template, ...] = (marked_turns, folded_system, last_answer_whole)


def spans(messages: list[Message], template: Template, closing: str = "") -> list[tuple[int, int, bool, str]]:
    """(start, end, rewrites history, rendered part) for each turn."""
    out, before = [], ""
    for k in range(1, len(messages) + 1):
        now = template(messages[:k])
        if closing and now.endswith(closing):
            now = now[: -len(closing)]
        if now.startswith(before):
            start, rewrites = len(before), False
        else:
            low, high = 0, min(len(now), len(before))  # longest common prefix, by halving
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if now[:mid] == before[:mid] else (low, mid - 1)
            start, rewrites = low, True
        out.append((start, len(now), rewrites, now[start:]))
        before = now
    return out


def format_chats(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, closing: str = "", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn and template: template (its function's name), conv_id, turn, ord, role, span_start, span_end, rewrites_history, conversation_rewritten (whether any turn rewrites), rendered.

    One shuffle, by conversation; a conversation must fit into a task, as the templates need it whole.
    """
    convs = df.groupBy(F.col(conv_id).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("user")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))).alias("turns")
    )
    columns = {"template": T.StringType(), "conv_id": df.schema[conv_id].dataType, "turn": df.schema[turn].dataType, "ord": T.IntegerType(), "role": T.StringType(), "span_start": T.IntegerType(), "span_end": T.IntegerType(), "rewrites_history": T.BooleanType(), "conversation_rewritten": T.BooleanType(), "rendered": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("turns")
            off, flat = lists.offsets.to_numpy(), lists.values
            held: list[list] = [[] for _ in range(9)]  # a turn's place in flat stands for turn and role
            size = 0

            def emit() -> pa.RecordBatch:
                template, conv, place, order, start, end, rewrites, any_rewrite, part = held
                at = pa.array(place, pa.int64())
                arrays = [pa.array(template, pa.string()), b.column("conv_id").take(pa.array(conv, pa.int64())), flat.field("turn").take(at), pa.array(order, pa.int32()), flat.field("role").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(rewrites, pa.bool_()), pa.array(any_rewrite, pa.bool_()), pa.array(part, pa.string())]
                return pa.RecordBatch.from_arrays(arrays, names=list(columns))

            for c in range(b.num_rows):
                roles, texts = (flat.field(n).slice(off[c], off[c + 1] - off[c]).to_pylist() for n in ("role", "text"))
                messages = [{"role": r, "text": t} for r, t in zip(roles, texts, strict=True)]
                for template in templates:
                    found = spans(messages, template, closing)
                    any_rewrite = any(x[2] for x in found)
                    for k, (start, end, rewrites, part) in enumerate(found):
                        for column, value in zip(held, (template.__name__, c, off[c] + k, k, start, end, rewrites, any_rewrite, part), strict=True):
                            column.append(value)
                        size += len(part)
                    if size > SLICE_BYTES:
                        yield emit()
                        held, size = [[] for _ in range(9)], 0
            if held[0]:
                yield emit()

    return convs.select("conv_id", "turns").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in columns.items()]))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS ord FROM conversations),
x AS (SELECT a.conv_id, a.ord AS k, b.role, b.text, b.ord FROM t a JOIN t b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.ord <= a.ord),
h AS (
  SELECT conv_id, k, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (role = 'system'), '') AS system,
         min(ord) FILTER (role <> 'system') AS first, max(ord) FILTER (role = 'assistant') AS answer FROM x GROUP BY conv_id, k),
e AS (SELECT x.*, h.system, h.first, h.answer FROM x JOIN h ON x.conv_id IS NOT DISTINCT FROM h.conv_id AND x.k = h.k),
r AS (
  SELECT 'marked_turns' AS template, conv_id, k, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY ord) AS now FROM e GROUP BY conv_id, k
  UNION ALL
  SELECT 'folded_system', conv_id, k, coalesce(string_agg(
           CASE WHEN role = 'user' THEN '[INST] ' ELSE ' ' END
           || CASE WHEN ord = first AND system <> '' THEN '<<SYS>>' || chr(10) || system || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END
           || text || CASE WHEN role = 'user' THEN ' [/INST]' ELSE ' </s>' END, '' ORDER BY ord) FILTER (role <> 'system'), '') FROM e GROUP BY conv_id, k
  UNION ALL
  SELECT 'last_answer_whole', conv_id, k, string_agg(
           '<|' || role || '|>' || chr(10) || CASE WHEN role <> 'assistant' OR ord = answer THEN text ELSE string_split(text, chr(10))[-1] END || chr(10), '' ORDER BY ord) FROM e GROUP BY conv_id, k),
b AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY template, conv_id ORDER BY k), '') AS before FROM r),
s AS (
  SELECT template, conv_id, k, now, NOT starts_with(now, before) AS rewrites_history,
         CASE WHEN starts_with(now, before) THEN length(before)
              ELSE coalesce(list_min([i for i in range(1, least(length(now), length(before)) + 1) if now[i] <> before[i]]) - 1, least(length(now), length(before))) END AS span_start FROM b)
SELECT s.template, t.conv_id, t.turn, t.ord::INTEGER AS ord, t.role, span_start::INTEGER AS span_start, length(now)::INTEGER AS span_end, rewrites_history,
       bool_or(rewrites_history) OVER (PARTITION BY s.template, s.conv_id) AS conversation_rewritten, substr(now, span_start + 1) AS rendered
FROM s JOIN t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.k = t.ord
"""
