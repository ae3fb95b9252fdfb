"""Chat formatting: records of many layouts to canonical turns, and turns to a marked, reversible text.

A record (a struct, or JSON text) is described by the set of its nested field paths, such as
``messages[].role``. The xxhash of that set is its fingerprint, and the fingerprint selects one of the
declarative ``LAYOUTS``; the choice is made once per fingerprint and kept. A record that no layout
covers yields no turn but a row with ``layout`` null, so nothing is lost silently.

A turn is written as ``<|turn|>ROLE\\nTEXT<|end|>\\n``. Control strings of this and of common other
templates get a backslash after their first character where they occur inside a text; one more when
backslashes are there already, so that taking one away always restores the text.

Nulls: a null text is empty, a null role is an empty role. Turns are in the order of their number (null
first), then role and text, so that repeated numbers have a defined order. Conversations may be of any
length: rows are formatted alone, and the conversation's digests are folded over sorted rows, one batch
in memory. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ship, table

TURN, END = "<|turn|>", "<|end|>\n"
#: What follows the first character of control strings; fixed values.
_TAIL = r"(\|(?:turn|end|im_start|im_end|endoftext|startoftext|system|user|assistant)\|>|/?s>|<SYS>>|</SYS>>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _TAIL)
_UNESCAPE = re.compile(r"([<\[])(\\*)\\" + _TAIL)


@dataclass(frozen=True)
class Layout:
    """``needs``: paths that must be there; ``turns``: (role, path) pairs, or one (role path, text path) list of messages."""

    name: str
    needs: frozenset[str]
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None  # list path, role field, text field


def _layout(name, needs, turns=(), each=None):
    return Layout(name, frozenset(needs), tuple(turns), each)


#: In order of preference; a path in ``turns`` that is absent or null is skipped.
LAYOUTS = (
    _layout("messages", ["messages[].role"], [("system", "system")], ("messages", "role", "content")),
    _layout("shares", ["conversations[].from"], [("system", "system")], ("conversations", "from", "value")),
    _layout("instruction", ["instruction"], [("system", "system"), ("user", "instruction"), ("user+", "input"), ("assistant", "output"), ("assistant", "response")]),
    _layout("prompt", ["prompt"], [("system", "system"), ("user", "prompt"), ("assistant", "completion"), ("assistant", "response"), ("assistant", "chosen")]),
    _layout("question", ["question"], [("system", "system"), ("user", "question"), ("assistant", "answer")]),
    _layout("turn", ["role"], each=("", "role", "text")),
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}  # other names of roles in shared dumps


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths; list elements share the path ``name[]``; a path that is null ends in ``?``."""
    if isinstance(value, dict):
        return set().union(*(paths_of(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *(paths_of(v, f"{at}[]") for v in value))
    return {at if value is not None else f"{at}?"} if at else set()


def fingerprint(paths: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)).encode())


def choose(paths: set[str]) -> Layout | None:
    """The first layout whose paths have values, else the first whose paths are there at all."""
    every = {p.removesuffix("?") for p in paths}
    return next((x for x in LAYOUTS if x.needs <= paths), None) or next((x for x in LAYOUTS if x.needs <= every), None)


def _at(value, path: str):
    for part in path.split(".") if path else ():
        value = value.get(part) if isinstance(value, dict) else None
    return value


def turns_of(record, known: dict[str, Layout | None]) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(fingerprint, layout name, canonical turns)."""
    if isinstance(record, str):
        try:
            record = json.loads(record)
        except ValueError:
            record = None
    paths = paths_of(record)
    print_ = fingerprint(paths)
    if print_ not in known:
        if len(known) > 100_000:
            known.clear()
        known[print_] = choose(paths)
    layout = known[print_]
    if layout is None:
        return print_, None, []
    out: list[tuple[str, str]] = []
    for role, path in layout.turns:
        text = _at(record, path)
        if text is not None:
            text = text if isinstance(text, str) else json.dumps(text)
            if role.endswith("+") and out:
                out[-1] = (out[-1][0], out[-1][1] + ("\n\n" + text if text else ""))
            else:
                out.append((role.rstrip("+"), text))
    if layout.each:
        where, role, text = layout.each
        items = _at(record, where) if where else [record]
        for item in items if isinstance(items, list) else []:
            if isinstance(item, dict):
                name = item.get(role)
                name = "" if name is None else str(name)
                body = item.get(text)
                out.append((ROLES.get(name, name) if where else name, "" if body is None else body if isinstance(body, str) else json.dumps(body)))
    return print_, layout.name, out


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, loss start, loss end): code points; an empty span for all but the assistant's text."""
    head = TURN + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    body = escape(text)
    end = len(head) + len(body) if role == "assistant" else len(head)
    return head + body + END, len(head), end


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, text start, text end) of every turn of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], formatted[at + len(TURN) : line])
        out.append((unescape(role), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END)
    return out


SEGMENT = "conv_id {id}, turn long, part int, fingerprint string, layout string, segment string, loss_start int, loss_end int"


def _format(batches):
    known: dict[str, Layout | None] = {}
    for batch in batches:
        out = [[] for _ in range(8)]
        for conv, turn, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            print_, layout, turns = turns_of(record, known)
            for part, (role, text) in enumerate(turns):
                for column, v in zip(out, (conv, turn, part, print_, layout, *format_turn(role, text))):
                    column.append(v)
            if layout is None:
                for column, v in zip(out, (conv, turn, 0, print_, None, "", 0, 0)):
                    column.append(v)
        types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)


def format_records(df: DataFrame, conv: str, turn, record) -> DataFrame:
    """A formatted segment for each turn of each record, with its loss span; rows are formatted where they are."""
    ship(df.sparkSession)
    rows = df.select(F.col(conv).alias("conv_id"), turn.cast("long").alias("turn"), record.alias("record"))
    return rows.mapInArrow(_format, SEGMENT.format(id=rows.schema["conv_id"].dataType.simpleString()))


def _read_back(batches):
    """One row per conversation of sorted segments, folded as they come."""
    types, now, state = None, None, None

    def row():
        n, turns, loss_chars, loss, chars = state
        return [now[0]], [n], [turns.hexdigest()], [loss_chars], [loss.hexdigest()], [chars]

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done = [[] for _ in types]
        for conv, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
            if now is None or now[0] != conv:
                if now is not None:
                    for column, v in zip(done, row()):
                        column += v
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(segment[a:b])
            state[2] += len(masked)
            state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(segment)
        if done[0]:
            yield emit(done)
    if now is not None:
        yield emit(row())


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text says when it is parsed again.

    The digest of a conversation runs through its turns in order, so one task reads it; the task holds
    one batch and the hash states, whatever the conversation's length.
    """
    ship(segments.sparkSession)
    order = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment").select("conv_id", "segment", "loss_start", "loss_end")
    kind = segments.schema["conv_id"].dataType.simpleString()
    return order.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], rows.schema))
    return read_back(format_records(rows, "conv_id", F.col("turn"), F.struct("role", "text")))


#: The digests and lengths of what the template must say when it is read back.
SQL = r"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
         s AS (SELECT *, '<|turn|>' || role || chr(10) || regexp_replace(text, '([<\[])(\\*)(\|(?:turn|end|im_start|im_end|endoftext|startoftext|system|user|assistant)\|>|/?s>|<SYS>>|</SYS>>|/?INST\])', '\1\2\\\3', 'g') || '<|end|>' || chr(10) AS segment FROM r),
         g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, segment) AS told,
                      coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, segment) FILTER (WHERE role = 'assistant'), '') AS loss, sum(length(segment))::BIGINT AS formatted_chars FROM s GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
